"""The queries of the problems tagged llm, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import leakage, lookalike, neardup, pieces, spans, tokenize
from lexmill.session import Workspace, table

Query = Callable[[SparkSession, str], DataFrame]
CLAUSE = ["doc_id", "clause_id"]


def near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "clauses", *CLAUSE, "clause_text"), CLAUSE, "clause_text", width=3, threshold="0.6", least_words=12)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(*near(spark, d), CLAUSE)


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.links(*near(spark, d), CLAUSE, neardup.records_of(table(spark, d, "clauses", *CLAUSE, "clause_text"), CLAUSE, "clause_text"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("table_name"), "doc_id", F.col("chunk_id").alias("item_id"), "text")
    clauses = table(spark, d, "clauses").select(F.lit("clauses").alias("table_name"), "doc_id", F.col("clause_id").alias("item_id"), F.col("clause_text").alias("text"))
    return pieces.split_oversized(chunks.unionByName(clauses), ["table_name", "doc_id", "item_id"], "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).select("table_name", "doc_id", "item_id").distinct()


def p2_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item hold together: how many characters, the hash of the text they make, and whether each
    starts before the end of the one before and by no more than the overlap, and keeps the limit."""
    item = ["table_name", "doc_id", "item_id"]
    rows = p2_pieces(spark, d).groupBy(*item).agg(F.sort_array(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece_text", "token_estimate"))).alias("p"))
    before = lambda k: F.coalesce(F.get("p", k - 1)["piece_end"], F.lit(0))
    good = lambda x, k: F.when(k == 0, x["piece_start"] == 0).otherwise((x["piece_start"] < before(k)) & (before(k) - x["piece_start"] <= 4 * pieces.OVERLAP) & (x["piece_no"] == k))
    whole = F.array_join(F.transform("p", lambda x, k: F.substr(x["piece_text"], (before(k) - x["piece_start"] + 1).cast("int"))), "")
    limited = F.forall("p", lambda x: (x["token_estimate"] <= pieces.LIMIT) & (x["token_estimate"] == F.greatest(F.lit(1), F.floor(F.length(x["piece_text"]) / 4))))
    overlaps = F.forall(F.transform("p", good), lambda x: x)
    return rows.select(*item, F.length(whole).alias("n_chars"), F.md5(whole).alias("text_hash"), limited.alias("limited"), overlaps.alias("overlaps"), (F.size("p") > 1).alias("several"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    cleaned = table(spark, d, "cleaned").select(F.lit("cleaned").alias("table_name"), "doc_id", F.col("doc_id").alias("row_key"), F.col("cleaned_text").alias("text"))
    entities = table(spark, d, "entities").select(F.lit("entities").alias("table_name"), "doc_id", F.col("entity_id").alias("row_key"), F.col("entity_text").alias("text"))
    return cleaned.unionByName(entities)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.inconsistent(p3_texts(spark, d), ["table_name", "doc_id", "row_key"], "text")


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(p3_texts(spark, d), "text")


def p3_residue(spark: SparkSession, d: str) -> DataFrame:
    """Of each table: its rows, the texts that the consistent form changes, and those that aren't in it afterwards."""
    rows = Workspace(spark, "residue").write(p3_consistent(spark, d))
    left = lookalike.inconsistent(rows.withColumn("n", F.monotonically_increasing_id()), ["table_name", "n"], "consistent_text").groupBy("table_name").agg(F.count("*").alias("n_left"))
    told = rows.groupBy("table_name").agg(F.count("*").alias("n"), F.count_if(F.col("text") != F.col("consistent_text")).alias("n_changed"))
    return told.join(left, "table_name", "left").select("table_name", "n", "n_changed", F.coalesce("n_left", F.lit(0)).alias("n_left"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "eval_items", "item_id", "text"), table(spark, d, "documents", "doc_id", "text"))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(table(spark, d, "eval_items", "item_id", "text"), table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents", "doc_id", "page_id", "text"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "page_id", "text")
    return spans.shared_share(docs, spans.shared_spans(docs))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_pieces, p2_cover, p3_found, p3_consistent, p3_residue, p6_ids, p7_found, p7_reparameterised, p8_found, p8_shared)}
