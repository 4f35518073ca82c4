"""Searches and reports over documents, graphs and logs, as the product's specification has them. Limits and thresholds
are the specification's, given as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.ordered import across, bucket_of
from lexmill.functions.text import strip
from lexmill.session import broadcast_if_small


def page_routes(pages: DataFrame, text: str, least: int = 20, n_pages: Column | None = None) -> DataFrame:
    """pages with `route`: NATIVE_TEXT where a page has `least` characters or more (of a text of n_pages, on average),
    OCR_FALLBACK where fewer, UNREADABLE for a null text. A null or zero number of pages counts as one."""
    count = F.lit(1) if n_pages is None else F.when(n_pages > 0, n_pages).otherwise(1)
    return pages.withColumn("route", F.when(F.col(text).isNull(), "UNREADABLE").when(F.length(text) / count < least, "OCR_FALLBACK").otherwise("NATIVE_TEXT"))


def merged_units(units: DataFrame, key: str = "doc_id", order: str = "ord", text: str = "clause_text") -> DataFrame:
    """key, unit_no, first_ord, last_ord, text: units without a whole sentence joined to the one before (those at the start
    to the one after), texts parted by a space, so that each unit is in exactly one. Null texts are empty; a text without
    any sentence is one unit."""
    whole = strip(F.coalesce(F.col(text), F.lit(""))).rlike(r"""[.!?][)\]"'”’»]*\z""")
    placed = across(units.select(key, order, text, whole.alias("_whole")), [key], [order], bucket_of(order), sums={"_no": F.col("_whole").cast("int")})
    # the units before the first whole sentence go with it
    number = F.greatest(F.col("_no") + F.col("_whole").cast("int"), F.lit(1)) - 1
    parts = F.sort_array(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    out = placed.groupBy(key, number.cast("int").alias("unit_no")).agg(F.min(order).alias("first_ord"), F.max(order).alias("last_ord"), parts.alias("p"))
    return out.select(key, "unit_no", "first_ord", "last_ord", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def nodes_within(reached: DataFrame, most: int = 500) -> DataFrame:
    """doc_id, start, node, hops of reach()'s rows: of each start the nearest `most`, ties by name; more aren't returned."""
    w = Window.partitionBy("doc_id", "start").orderBy("hops", "node")
    return reached.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def neighbourhood(edges: DataFrame, starts: DataFrame, radius: int, most: int = 150) -> DataFrame:
    """doc_id, start, n_nodes, refused, nodes: what lies within `radius` steps of a start (doc_id, start), either way and
    itself included, in order of names; null and refused where there are more than `most`. A start without edges is alone."""
    known = edges.where("source is not null and target is not null").select("doc_id", F.col("source").alias("node"), F.col("target").alias("next"))
    step = known.unionAll(known.select("doc_id", F.col("next").alias("node"), F.col("node").alias("next"))).distinct()
    now = every = starts.select("doc_id", "start", F.col("start").alias("node")).distinct()
    for _ in range(radius):
        now = now.join(step, ["doc_id", "node"]).select("doc_id", "start", F.col("next").alias("node")).distinct()
        every = every.unionAll(now)
    every = every.distinct()
    counted = every.groupBy("doc_id", "start").agg(F.count("*").alias("n_nodes"))
    kept = every.join(counted.where(F.col("n_nodes") <= most).select("doc_id", "start"), ["doc_id", "start"], "left_semi").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return counted.join(kept, ["doc_id", "start"], "left").select("doc_id", "start", "n_nodes", (F.col("n_nodes") > most).alias("refused"), "nodes")


def effective_text(originals: DataFrame, amendments: DataFrame, key: str, text: str, as_of: Column) -> DataFrame:
    """key, text, amended_at: of each original the text of its latest amendment (key, text, effective_at) by `as_of`, ties
    by text; the original one, with a null amended_at, where there is none."""
    last = amendments.where(F.col("effective_at") <= as_of).groupBy(key).agg(F.max(F.struct("effective_at", F.col(text).alias("t"))).alias("a"))
    return originals.join(last, key, "left").select(key, F.when(F.col("a").isNotNull(), F.col("a.t")).otherwise(F.col(text)).alias(text), F.col("a.effective_at").alias("amended_at"))


def tokens(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def full_text(queries: DataFrame, rows: DataFrame, scope: str, k: int = 10, longest: int = 256) -> DataFrame:
    """query_id, row_id, score, rank: for each query (query_id, scope, query) the k rows (row_id, scope, text) of the same
    scope that hold most of its distinct words, ties by row_id. The scope is part of the join, so no row of another one is
    ever met. Queries are cut at `longest` characters, null scopes match nothing; a query without words has no row."""
    asked = queries.select("query_id", scope, F.explode(tokens("query")).alias("w")) if longest is None else queries.withColumn("query", F.substring("query", 1, longest)).select("query_id", scope, F.explode(tokens("query")).alias("w"))
    words = broadcast_if_small(asked.select(scope, "w").distinct(), asked.count(), 64)
    held = rows.select("row_id", scope, F.explode(tokens("text")).alias("w")).join(words, [scope, "w"], "left_semi")
    scored = held.join(asked, [scope, "w"]).groupBy("query_id", "row_id").agg(F.count("*").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page_after(rows: DataFrame, at: str, key: str, cursor: tuple | None, n: int) -> DataFrame:
    """The n newest rows after the cursor (at, key), or from the start: a page that stays put while rows are added. Rows
    without a time come last."""
    if cursor is not None:
        time, last = cursor
        after = (F.col(at) < F.lit(time)) | ((F.col(at) == F.lit(time)) & (F.col(key) < F.lit(last))) | F.col(at).isNull()
        rows = rows.where(after if time is not None else F.col(at).isNull() & (F.col(key) < F.lit(last)))
    return rows.orderBy(F.desc_nulls_last(at), F.desc(key)).limit(n)


def latest_of(rows: DataFrame, group: str, at: str, key: str, n: int = 5) -> DataFrame:
    """rows with n_rows, the number of its group, of the n newest of each group. Groups are counted before they are cut, and
    only times and keys are ordered."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(at), F.desc(key))
    top = rows.select(group, key, at).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(rows.groupBy(group).agg(F.count("*").alias("n_rows")), group)


def duplicates_by_owner(rows: DataFrame, owner: str, key: str, text: str) -> DataFrame:
    """owner, hash, n, first_key of texts that one owner has several times; null texts and owners are left out."""
    known = rows.where(F.col(owner).isNotNull() & F.col(text).isNotNull())
    return known.groupBy(owner, F.sha2(text, 256).alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def import_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, change (`add`, `remove` or `modify`) and fields, the columns that differ (null differs from a value), parted by
    commas, of what an import of `new` would do to `old`; nothing is written. Keys must be unique on both sides."""
    a = old.select(F.struct(*keys).alias("_k"), F.struct(*columns).alias("_a"))
    b = new.select(F.struct(*keys).alias("_k"), F.struct(*columns).alias("_b"))
    both = a.join(b, "_k", "full_outer")
    fields = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns])), ",")
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "remove").when(fields != "", "modify")
    told = both.select(*[F.col(f"_k.{c}").alias(c) for c in keys], change.alias("change"), F.when(change == "modify", fields).alias("fields"))
    return told.where("change is not null")


def log_page(logs: DataFrame, at: str, key: str, begin: str, end: str, equal: dict[str, str], cursor: tuple | None = None, n: int = 100, most_days: int = 90) -> DataFrame:
    """A page of the log rows from `begin` up to `end` (not included), at most most_days apart, whose columns have the given
    values, newest first."""
    from datetime import datetime, timedelta

    if datetime.fromisoformat(end) - datetime.fromisoformat(begin) > timedelta(days=most_days):
        raise ValueError(f"at most {most_days} days can be searched")
    kind = logs.schema[at].dataType
    rows = logs.where((F.col(at) >= F.lit(begin).cast(kind)) & (F.col(at) < F.lit(end).cast(kind)))
    for c, v in equal.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return page_after(rows, at, key, cursor, n)


def due(rows: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    """The rows whose time lies `days` or more before as_of; those without a time aren't due."""
    return rows.where(F.col(at) <= as_of - F.make_interval(days=F.lit(days)))


def rolling_counts(rows: DataFrame, group: str, at: str, days: int = 30) -> DataFrame:
    """group, day, n, n_rolling: rows a day, and those of the last `days` days, this one included. Days are counted before
    they are ordered, so a group is as many rows as it has days."""
    daily = rows.where(F.col(at).isNotNull()).groupBy(group, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.withColumn("n_rolling", F.sum("n").over(w))
