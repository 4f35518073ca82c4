"""The queries of the general problems, each over its whole tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import hierarchy as H
from lexmill.operators import orphans as O
from lexmill.session import table

TREE = ["table_name", "doc_id"]


def tree_rows(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "sections").select(F.lit("sections").alias("table_name"), "doc_id", F.col("section_id").alias("node_id"), F.col("parent_section_id").alias("parent_id"), "level", "ingested_at")
    blocks = table(spark, d, "blocks").select(F.lit("blocks").alias("table_name"), "doc_id", F.col("block_id").alias("node_id"), F.col("parent_block_id").alias("parent_id"), "level", "ingested_at")
    return sections.unionByName(blocks)


def trees(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(tree_rows(spark, d), TREE, "node_id", "parent_id", "ingested_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    levels = tree_rows(spark, d).groupBy(*TREE, "node_id").agg(F.max(F.struct("ingested_at", "level")).alias("x")).select(*TREE, "node_id", "x.level")
    told = trees(spark, d).join(levels, [*TREE, "node_id"])
    fault = F.when(F.col("status").isin("cycle", "below_cycle", "lost_parent"), F.col("status")).when((F.col("status") == "ok") & (F.col("level") != F.col("depth")), "wrong_level")
    return told.withColumn("fault", fault).where("fault is not null").select(*TREE, "node_id", "fault")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = trees(spark, d)
    counts = H.descendant_counts(tree, TREE)
    return tree.join(counts, [*TREE, "node_id"], "left").select(*TREE, "node_id", "parent_id", "root_id", "depth", "path", "status", F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(trees(spark, d), TREE)


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with a key: ends of edges and resolved clauses, with the kind of record they name."""
    edges = table(spark, d, "edges", "doc_id", "ord", "source", "target", "ingested_at")
    ends = edges.select(F.lit("edges").alias("table_name"), "doc_id", "ord", F.explode(F.array(F.struct(F.lit("source").alias("field_name"), F.col("source").alias("end")), F.struct(F.lit("target").alias("field_name"), F.col("target").alias("end")))).alias("x"), F.col("ingested_at").alias("at"))
    ends = ends.select("table_name", "x.field_name", "doc_id", "ord", "x.end", "at").where("end is not null and not startswith(end, 'unresolved_')")
    prefix, rest = F.regexp_extract("end", r"^(law|chapter|section|subsection|clause)_", 1), F.regexp_replace("end", r"^(?:law|chapter|section|subsection|clause)_", "")
    ends = ends.withColumn("prefix", prefix).withColumn("rest", rest)
    kind = F.when(F.col("prefix") == "law", "law").when(F.col("prefix") == "clause", "clause").when(F.col("prefix") == "", "none").otherwise("section")
    ends = ends.select("table_name", "field_name", "doc_id", "ord", kind.alias("kind"), F.when(kind == "law", F.col("rest")).otherwise(F.col("doc_id")).alias("owner"), F.when(kind == "law", "").otherwise(F.col("rest")).alias("key"), "at")
    refs = table(spark, d, "clause_refs", "doc_id", "ord", "resolved_clause_id", "ingested_at").where("resolved_clause_id is not null")
    refs = refs.select(F.lit("clause_refs").alias("table_name"), F.lit("resolved_clause_id").alias("field_name"), "doc_id", "ord", F.lit("clause").alias("kind"), F.col("doc_id").alias("owner"), F.col("resolved_clause_id").alias("key"), F.col("ingested_at").alias("at"))
    return ends.unionByName(refs).withColumn("at", F.col("at").cast("timestamp_ntz"))


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    cleaned = table(spark, d, "cleaned", "doc_id", "ingested_at").select(F.lit("law").alias("kind"), F.col("doc_id").alias("owner"), F.lit("").alias("key"), F.col("ingested_at").alias("at"), F.lit(False).alias("deleted"))
    sections = table(spark, d, "sections", "doc_id", "section_id", "ingested_at", "deleted_at").select(F.lit("section").alias("kind"), F.col("doc_id").alias("owner"), F.col("section_id").alias("key"), F.col("ingested_at").alias("at"), F.col("deleted_at").isNotNull().alias("deleted"))
    clauses = table(spark, d, "clauses", "doc_id", "clause_id", "ingested_at", "deleted_at").select(F.lit("clause").alias("kind"), F.col("doc_id").alias("owner"), F.col("clause_id").alias("key"), F.col("ingested_at").alias("at"), F.col("deleted_at").isNotNull().alias("deleted"))
    return cleaned.unionByName(sections).unionByName(clauses).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Slices of arrival time for the final state alone, which is the same for any number of them.
SLICES = 3


def arrivals(references: DataFrame, parents: DataFrame) -> tuple[datetime | None, datetime | None]:
    """The first and the last arrival of either side."""
    return tuple(references.select("at").unionAll(parents.select("at")).agg(F.min("at"), F.max("at")).first())


def month_ends(first: datetime | None, last: datetime | None) -> list[datetime]:
    """The last microsecond of each month from the first arrival to the last, but for the month of the last."""
    cuts = []
    while first is not None and (first.year, first.month) < (last.year, last.month):
        first = (first.replace(day=1) + timedelta(days=32)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        cuts.append(first - timedelta(microseconds=1))
    return cuts


def replayed(spark: SparkSession, d: str, rule: str = "any") -> O.OrphanStore:
    references, parents = reference_rows(spark, d), parent_rows(spark, d)
    span = references.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    cuts = [span.a + (span.b - span.a) * k / SLICES for k in range(1, SLICES)] if span.a is not None else []
    return O.replay(references, parents, cuts, rule)[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, d).orphans()


def p5_reopened(spark: SparkSession, d: str) -> DataFrame:
    """The same by the last row of each key: a deletion takes back what was there, so settled references wait again."""
    return replayed(spark, d, "last").orphans()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n"))


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the references that waited at each month end between the first and the last arrival, and at the end."""
    references, parents = reference_rows(spark, d), parent_rows(spark, d)
    return O.snapshots(references, parents, month_ends(*arrivals(references, parents)))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p5_found, p5_reopened, p5_counts, p5_snapshots)}


def oracle_sql() -> dict[str, str]:
    nodes = """nodes AS (
        SELECT table_name, doc_id, node_id, arg_max(coalesce(parent_id, chr(1)), ingested_at) AS p, max(level) AS level FROM (
            SELECT 'sections' AS table_name, doc_id, section_id AS node_id, parent_section_id AS parent_id, level, ingested_at FROM sections
            UNION ALL SELECT 'blocks', doc_id, block_id, parent_block_id, level, ingested_at FROM blocks) GROUP BY ALL),
      n AS (SELECT table_name, doc_id, node_id, nullif(p, chr(1)) AS parent_id, level FROM nodes),
      up(table_name, doc_id, node_id, at_id, dist, seen) AS (
        SELECT table_name, doc_id, node_id, node_id, 0, [node_id] FROM n
        UNION ALL SELECT u.table_name, u.doc_id, u.node_id, n.parent_id, u.dist + 1, list_append(u.seen, n.parent_id)
        FROM up u JOIN n ON n.table_name = u.table_name AND n.doc_id = u.doc_id AND n.node_id = u.at_id
        WHERE n.parent_id IS NOT NULL AND NOT list_contains(u.seen[:len(u.seen) - 1], u.at_id)),
      ends AS (SELECT u.*, row_number() OVER (PARTITION BY table_name, doc_id, node_id ORDER BY dist DESC) AS r FROM up u),
      told AS (SELECT n.*, e.at_id, e.dist, e.seen, list_contains(e.seen[:len(e.seen) - 1], e.at_id) AS again, t.node_id IS NOT NULL AS known, t.parent_id AS top_parent
        FROM ends e JOIN n USING (table_name, doc_id, node_id) LEFT JOIN n t ON t.table_name = e.table_name AND t.doc_id = e.doc_id AND t.node_id = e.at_id WHERE e.r = 1)"""
    ways = f"""WITH RECURSIVE {nodes},
      way AS (SELECT *, CASE WHEN again THEN NULL WHEN known THEN seen ELSE seen[:len(seen) - 1] END AS way FROM told),
      under AS (SELECT table_name, doc_id, unnest(way[2:]) AS node_id, node_id AS descendant_id, generate_subscripts(way[2:], 1) AS distance FROM way WHERE way IS NOT NULL)"""
    return {
        "p4_paths": f"""{ways}, counts AS (SELECT table_name, doc_id, node_id, count(*) AS n FROM under GROUP BY ALL)
      SELECT table_name, doc_id, node_id, parent_id, way[len(way)] AS root_id, len(way) AS depth, array_to_string(list_reverse(way), '/') AS path, CASE WHEN again AND at_id = node_id THEN 'cycle'
        WHEN again THEN 'below_cycle' WHEN NOT known AND dist = 1 THEN 'lost_parent' WHEN NOT known THEN 'below_lost' ELSE 'ok' END AS status, coalesce(n, 0) AS n_descendants
      FROM way LEFT JOIN counts USING (table_name, doc_id, node_id)""",
        "p4_descendants": f"{ways} SELECT table_name, doc_id, node_id, descendant_id, distance FROM under",
        "p5_snapshots": P5_SNAPSHOTS_SQL,
        "p4_found": f"""WITH RECURSIVE {nodes}
      SELECT table_name, doc_id, node_id, fault FROM (SELECT *, CASE
        WHEN again AND at_id = node_id THEN 'cycle'
        WHEN again THEN 'below_cycle'
        WHEN NOT known AND dist = 1 THEN 'lost_parent'
        WHEN known AND top_parent IS NULL AND level <> dist + 1 THEN 'wrong_level' END AS fault FROM told) WHERE fault IS NOT NULL""",
        "p5_found": P5_SQL,
        "p5_reopened": P5_SQL.replace("bool_or(deleted_at IS NULL)", "arg_max(deleted_at IS NULL, (ingested_at, deleted_at IS NULL))"),
        "p5_counts": f"SELECT table_name, field_name, period, reason, count(*) AS n FROM ({P5_SQL}) GROUP BY ALL",
    }


P5_SQL = """WITH refs AS (
        SELECT table_name, field_name, doc_id, ord, end_id, min(ingested_at) AS came FROM (
            SELECT 'edges' AS table_name, 'source' AS field_name, doc_id, ord, source AS end_id, ingested_at FROM edges
            UNION ALL SELECT 'edges', 'target', doc_id, ord, target, ingested_at FROM edges
            UNION ALL SELECT 'clause_refs', 'resolved_clause_id', doc_id, ord, 'clause_' || resolved_clause_id, ingested_at FROM clause_refs)
        WHERE end_id IS NOT NULL AND NOT starts_with(end_id, 'unresolved_') GROUP BY ALL),
      keys AS (
        SELECT 'law_' || doc_id AS k, doc_id, min(ingested_at) AS first_at, TRUE AS live FROM cleaned GROUP BY ALL
        UNION ALL SELECT 'section_' || section_id, doc_id, min(ingested_at), bool_or(deleted_at IS NULL) FROM sections GROUP BY ALL
        UNION ALL SELECT 'clause_' || clause_id, doc_id, min(ingested_at), bool_or(deleted_at IS NULL) FROM clauses GROUP BY ALL),
      named AS (SELECT *, CASE WHEN starts_with(end_id, 'law_') THEN substr(end_id, 5) ELSE doc_id END AS owner,
        regexp_replace(end_id, '^(chapter|subsection)_', 'section_') AS k FROM refs)
      SELECT DISTINCT table_name, field_name, strftime(came, '%Y-%m') AS period, r.doc_id, ord,
        CASE WHEN first_at IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' ELSE 'late' END AS reason
      FROM named r LEFT JOIN keys s ON s.k = r.k AND s.doc_id = r.owner
      WHERE first_at IS NULL OR NOT live OR first_at > came"""


P5_SNAPSHOTS_SQL = """WITH refs AS (
        SELECT table_name, field_name, doc_id, ord, end_id, min(ingested_at) AS came FROM (
            SELECT 'edges' AS table_name, 'source' AS field_name, doc_id, ord, source AS end_id, ingested_at FROM edges
            UNION ALL SELECT 'edges', 'target', doc_id, ord, target, ingested_at FROM edges
            UNION ALL SELECT 'clause_refs', 'resolved_clause_id', doc_id, ord, 'clause_' || resolved_clause_id, ingested_at FROM clause_refs)
        WHERE end_id IS NOT NULL AND NOT starts_with(end_id, 'unresolved_') GROUP BY ALL),
      parents AS (SELECT 'law_' || doc_id AS k, doc_id, ingested_at AS seen_at, TRUE AS live FROM cleaned
        UNION ALL SELECT 'section_' || section_id, doc_id, ingested_at, deleted_at IS NULL FROM sections
        UNION ALL SELECT 'clause_' || clause_id, doc_id, ingested_at, deleted_at IS NULL FROM clauses),
      keys AS (SELECT k, doc_id, min(seen_at) AS first_at, min(seen_at) FILTER (live) AS live_at FROM parents GROUP BY ALL),
      named AS (SELECT *, CASE WHEN starts_with(end_id, 'law_') THEN substr(end_id, 5) ELSE doc_id END AS owner, regexp_replace(end_id, '^(chapter|subsection)_', 'section_') AS k FROM refs),
      facts AS (SELECT table_name, field_name, strftime(came, '%Y-%m') AS period, came, first_at, live_at FROM named r LEFT JOIN keys s ON s.k = r.k AND s.doc_id = r.owner),
      span AS (SELECT min(seen_at) AS a, max(seen_at) AS b FROM (SELECT came AS seen_at FROM refs UNION ALL SELECT seen_at FROM parents)),
      cuts AS (SELECT m - INTERVAL 1 MICROSECOND AS c, strftime(m - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS as_of
          FROM (SELECT unnest(generate_series(date_trunc('month', a) + INTERVAL 1 MONTH, date_trunc('month', b), INTERVAL 1 MONTH)) AS m FROM span)
        UNION ALL SELECT TIMESTAMP '9999-01-01', 'end'),
      told AS (SELECT table_name, field_name, period, as_of, CASE WHEN first_at IS NULL OR first_at > c THEN 'missing' WHEN live_at IS NULL OR live_at > c THEN 'deleted' WHEN first_at > came THEN 'late' END AS reason
        FROM facts, cuts WHERE came <= c)
      SELECT table_name, field_name, period, reason, as_of, count(*) AS n FROM told WHERE reason IS NOT NULL GROUP BY ALL"""
