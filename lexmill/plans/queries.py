"""Queries of the document and graph operators over the legal tables. Records are the latest row of each key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import latest
from lexmill.operators import blocks as B
from lexmill.operators import classify as K
from lexmill.operators import clauses as C
from lexmill.operators import cleaning, enrich, entities, graph, sections, vectors
from lexmill.plans import pipeline
from lexmill.session import Workspace, table
from lexmill.sinks import graph_store
from lexmill.sources import documents


def texts(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "cleaned", "doc_id", "title", "cleaned_text", "ingested_at"), ["doc_id"], "ingested_at").drop("ingested_at")


def clause_rows(spark: SparkSession, d: str) -> DataFrame:
    columns = ("doc_id", "clause_id", "ord", "section_id", "section_title", "clause_text", "ingested_at")
    return latest(table(spark, d, "clauses", *columns), ["doc_id", "clause_id"], "ingested_at").drop("ingested_at")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.clean(texts(spark, d).withColumnRenamed("cleaned_text", "raw"), "raw")
    return out.select("doc_id", "cleaned_text", F.array_join("cleaning_notes", "; ").alias("notes"))


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return sections.lines(texts(spark, d))


def headings(spark: SparkSession, d: str) -> DataFrame:
    return sections.headings(texts(spark, d))


def heading_style_counts(spark: SparkSession, d: str) -> DataFrame:
    return headings(spark, d).groupBy("style", "level").agg(F.count("*").alias("n"))


def section_rows(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(texts(spark, d))


def section_tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return sections.tree_depths(section_rows(spark, d))


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    return B.blocks(Workspace(spark, "sections").write(section_rows(spark, d)))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_of(spark, d)


def blocks_by_type(spark: SparkSession, d: str) -> DataFrame:
    return blocks_of(spark, d).groupBy("block_type", "depth").agg(F.count("*").alias("n"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return B.candidates(blocks_of(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("block_ids", "link_block_ids", "table_block_ids", "note_block_ids")})


def pipeline_clauses(spark: SparkSession, d: str) -> DataFrame:
    return C.clauses(Workspace(spark, "candidates").write(B.candidates(blocks_of(spark, d))))


def clause_units(spark: SparkSession, d: str) -> DataFrame:
    return C.units(clause_rows(spark, d), ["doc_id", "clause_id"], "clause_text")


def clause_roles(spark: SparkSession, d: str) -> DataFrame:
    return K.classify(clause_rows(spark, d)).select("doc_id", "clause_id", "role", "confidence", F.array_join("reasons", ",").alias("reasons"))


def clause_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return K.context(clause_rows(spark, d)).select("doc_id", "clause_id", "previous_clause_id", "next_clause_id", F.array_join("neighbor_clause_ids", ",").alias("neighbors"))


def section_positions(spark: SparkSession, d: str) -> DataFrame:
    return K.context(clause_rows(spark, d)).select("doc_id", "clause_id", "section_position", "is_first_in_section", "is_last_in_section")


def references(spark: SparkSession, d: str) -> DataFrame:
    return K.references(clause_rows(spark, d))


def entity_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    work = Workspace(spark, "entities")
    rows = work.write(clause_rows(spark, d))
    refs = work.write(K.references(rows))
    return rows, refs, entities.numbered(work.write(entities.raw_entities(rows, refs)), rows)


ENTITY = ["doc_id", "clause_id", "entity_id", "entity_text", "entity_type", "start_offset", "end_offset", "confidence", "detection_method"]


def entities_raw(spark: SparkSession, d: str) -> DataFrame:
    return entity_parts(spark, d)[2].select(*ENTITY)


def entities_merged(spark: SparkSession, d: str) -> DataFrame:
    return entities.merged(entity_parts(spark, d)[2]).select(*ENTITY)


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return entities_merged(spark, d).groupBy("entity_type", "detection_method").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows, refs, raw = entity_parts(spark, d)
    made = entities.chunks(K.classify(rows), entities.merged(raw), refs)
    return made.select("doc_id", "chunk_id", "text", "token_estimate", *[F.coalesce(F.try_element_at("context", F.lit(k)), F.lit("")).alias(k) for k in ("role", "section_id", "confidence", "classification_reason", "entities", "references")])


def preview_json(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.preview(pipeline.run(texts(spark, d).withColumnRenamed("cleaned_text", "raw_text")))


def preview_counts(spark: SparkSession, d: str) -> DataFrame:
    """How much each list of a preview holds, read back from its JSON."""
    lists = ("sections", "clauses", "classifications", "references", "entities", "chunks")
    read = F.from_json("preview", ", ".join(f"{n} array<map<string,string>>" for n in lists))
    return preview_json(spark, d).withColumn("p", read).select("doc_id", *[F.size(f"p.{n}").alias(f"n_{n}") for n in lists], F.get("p.clauses", F.lit(0))["clause_text"].alias("first_clause"))


def document_json(spark: SparkSession, d: str) -> DataFrame:
    """How much the JSON of each document, the prompt for its graph, holds, read back from it."""
    rows, refs, raw = entity_parts(spark, d)
    made = enrich.document_json(texts(spark, d).select("doc_id", "title"), K.context(K.classify(rows)), entities.merged(raw), refs)
    kind = "document struct<document_id:string,title:string>, clauses array<struct<clause_id:string,role:string,entities:array<struct<entity_id:string>>,references:array<struct<reference_text:string>>,context:struct<next_clause_id:string>>>"
    read = made.withColumn("j", F.from_json("document_json", kind))
    total = lambda name: F.aggregate("j.clauses", F.lit(0), lambda acc, c: acc + F.size(c[name]))
    return read.select("doc_id", F.col("j.document.title").alias("title"), F.size("j.clauses").alias("n_clauses"), total("entities").alias("n_entities"), total("references").alias("n_references"), F.get("j.clauses", F.lit(0))["context"]["next_clause_id"].alias("second_clause"))


def loaded_documents(spark: SparkSession, d: str) -> DataFrame:
    """The stored texts taken as files of their format (PDF as upper-case TXT, as its parser's library may be missing): what
    loads, and what is told of the rest."""
    rows = latest(table(spark, d, "cleaned", "doc_id", "title", "document_format", "cleaned_text", "ingested_at"), ["doc_id"], "ingested_at")
    suffix = F.when(F.col("document_format") == "pdf", "TXT").otherwise(F.col("document_format"))
    files = rows.select(F.concat(F.lit("in/"), "doc_id", F.lit("."), suffix).alias("path"), F.encode("cleaned_text", "utf-8").alias("content"), "title")
    return documents.load(files).select("doc_id", "filename", "document_format", "title", "error_kind", "error_msg", F.length("raw_text").alias("n_chars"))


def hierarchy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    work = Workspace(spark, "graph")
    rows = work.write(clause_rows(spark, d))
    nodes, edges = graph.hierarchy(rows, texts(spark, d).select("doc_id", "title"))
    return rows, work.write(nodes), edges


def flat(nodes: DataFrame) -> DataFrame:
    keys = ("number", "title", "identifier", "clause_id", "law_code", "reference_type")
    return nodes.select("doc_id", "id", "label", *[F.coalesce(F.try_element_at("properties", F.lit(k)), F.lit("")).alias(k) for k in keys])


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flat(hierarchy(spark, d)[1])


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(spark, d)[2].select("doc_id", "source", "target", "type")


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, nodes, edges = hierarchy(spark, d)
    return nodes, edges, graph.resolve(nodes, rows, K.references(rows))


def resolved_refs(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)[2].where("target is not null").select("doc_id", "clause_id", "kind", "value", "ref_text", "target")


def unresolved_refs(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)[2].where("target is null").select("doc_id", "clause_id", "kind", "value", "ref_text")


def linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges, refs = resolved(spark, d)
    work = Workspace(spark, "linked")
    nodes, edges = graph.link(nodes, edges, work.write(refs))
    return work.write(nodes), work.write(edges)


def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.violations(*linked(spark, d), texts(spark, d))


def edge_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules broken by the stored edges against the nodes of the hierarchy."""
    edges = latest(table(spark, d, "edges", "doc_id", "ord", "source", "target", "rel_type", "ingested_at"), ["doc_id", "ord"], "ingested_at").withColumnRenamed("rel_type", "type")
    return graph.violations(hierarchy(spark, d)[1], edges, texts(spark, d)).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def built_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each document's graph, and the first rule it breaks."""
    return graph_store.build_from_graphs(*linked(spark, d), texts(spark, d)).select("doc_id", "nodes_in_ir", "relationships_in_ir", "error")


def stand_in(system: str, user: str) -> str:
    """Answers like a model would: one obligation where a clause says shall, nonsense where it says must."""
    text = user.split("Clause:\n\n", 1)[1]
    if "shall" in text:
        return json.dumps({"obligations": [{"subject": text[:3], "action": "shall", "object": str(len(text)), "condition": "", "exception": None}]})
    return "oops" if "must" in text else '{"obligations": []}'


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The obligations that a stand-in for a model finds in the stored clauses, and the clauses whose answer can't be read."""
    _, nodes, edges = hierarchy(spark, d)
    more, _, failed = enrich.enrich(nodes, edges, stand_in)
    made = more.where("label = 'Obligation'").select("doc_id", "id", F.lit(None).cast("string").alias("error"), *[F.element_at("properties", k).alias(k) for k in ("subject", "object", "condition")])
    return made.unionByName(failed.select("doc_id", "id", "error", *[F.lit(None).cast("string").alias(k) for k in ("subject", "object", "condition")]))


def cypher_ops(spark: SparkSession, d: str) -> DataFrame:
    return graph.cypher(*linked(spark, d))


def exported_labels(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph.exported(*linked(spark, d))
    return nodes.groupBy(F.lit("node").alias("part"), F.col("label").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(*linked(spark, d))


def traversal_4hop(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each law reaches over the stored edges within four steps."""
    edges = latest(table(spark, d, "edges", "doc_id", "ord", "source", "target", "ingested_at"), ["doc_id", "ord"], "ingested_at").where("source is not null and target is not null").select("doc_id", "source", "target").distinct()
    return vectors.reach(edges, edges.where("startswith(source, 'law_')").select("doc_id", F.col("source").alias("start")).distinct(), 4).groupBy("doc_id", "start", "hops").agg(F.count("*").alias("n"))


def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows by cosine of every row whose id is divisible by 50, among all other rows."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    return vectors.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


def clause_versions_asof(spark: SparkSession, d: str) -> DataFrame:
    """The state of each clause as of the first of July 2024: the last row that had arrived by then, if not deleted."""
    rows = table(spark, d, "clauses", "doc_id", "clause_id", "clause_text", "ingested_at", "deleted_at").where("ingested_at <= timestamp_ntz'2024-07-01 00:00:00'")
    return latest(rows, ["doc_id", "clause_id"], "ingested_at").where("deleted_at is null or deleted_at > timestamp_ntz'2024-07-01 00:00:00'").select("doc_id", "clause_id", F.length("clause_text").alias("n_chars"))


def queries() -> dict:
    every = (
        clean_text, doc_lines, headings, heading_style_counts, section_tree_depth, blocks, blocks_by_type, candidates, pipeline_clauses, clause_units, clause_roles, clause_neighbors, section_positions,
        references, entities_raw, entities_merged, entity_counts, chunks, preview_json, preview_counts, document_json, loaded_documents, graph_nodes, graph_edges, resolved_refs, unresolved_refs, graph_violations, edge_violations, cypher_ops, built_graphs, enriched, exported_labels,
        graph_stats, traversal_4hop, knn_top10, clause_versions_asof,
    )
    return {f.__name__: f for f in every} | {"sections": section_rows}
