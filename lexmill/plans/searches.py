"""Queries of the searches and findings over the test tables, with their SQL. Tables of a knowledge graph aren't among the
test tables; obligations are made of the embeddings by rule, documents and entities are the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import latest
from lexmill.operators import findings as G
from lexmill.operators import search as S
from lexmill.operators import vectors
from lexmill.plans.queries import clause_rows
from lexmill.plans.sql import CLAUSES, SP, q, spans_cte
from lexmill.session import table

AS_OF, BEFORE = "2025-01-01 00:00:00", "2024-07-01 00:00:00"
# Tags of the specification's taxonomy, with some terms of each.
TAXONOMY = [
    ("DATA_TYPE", "meter data"), ("DATA_TYPE", "ledger"), ("RETENTION_PERIOD", "48 hours"), ("RETENTION_PERIOD", "days"), ("THIRD_PARTY", "commission"), ("THIRD_PARTY", "trust"), ("PURPOSE", "audit"),
    ("CONSENT_MECHANISM", "consent"), ("SECURITY_MEASURE", "seal"), ("AUTHORITY_REFERENCE", "board"), ("AUTHORITY_REFERENCE", "tribunal"), ("JURISDICTION_REFERENCE", "district"), ("SPDI_CATEGORY", "medical record"),
]
PHRASES = {"shall not": "SATISFIED", "must": "MISSING"}


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "edges", "doc_id", "ord", "source", "target", "rel_type", "ingested_at"), ["doc_id", "ord"], "ingested_at")
    return rows.where("source is not null and target is not null").select("doc_id", "source", "target", F.col("rel_type").alias("type")).distinct()


def law_starts(edges: DataFrame) -> DataFrame:
    return edges.where("startswith(source, 'law_')").select("doc_id", F.col("source").alias("start")).distinct()


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "cleaned", "doc_id", "cleaned_text", "page_count", "ingested_at"), ["doc_id"], "ingested_at")
    return S.page_routes(rows, "cleaned_text", 2000, F.col("page_count")).select("doc_id", "route")


def merged_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Units of the stored clauses, numbered by their place, ties by id."""
    rows = latest(table(spark, d, "clauses", "doc_id", "clause_id", "ord", "clause_text", "ingested_at"), ["doc_id", "clause_id"], "ingested_at")
    once = rows.groupBy("doc_id", "ord").agg(F.min_by("clause_text", "clause_id").alias("clause_text"))
    return S.merged_units(once)


def taxonomy_tags(spark: SparkSession, d: str) -> DataFrame:
    return G.taxonomy_entities(clause_rows(spark, d), TAXONOMY, ["doc_id", "clause_id"])


def typed_expansion(spark: SparkSession, d: str) -> DataFrame:
    """From each law down to sections and clauses, and on to what a clause refers to, where it does."""
    edges = edge_rows(spark, d).withColumnRenamed("doc_id", "scope")
    now = law_starts(edges.withColumnRenamed("scope", "doc_id")).select(F.col("doc_id").alias("scope"), F.col("start").alias("at"))
    now = G.step(now, edges, "HAS_SECTION", "section").select("scope", F.col("at").alias("law"), "section", F.col("section").alias("at"))
    now = G.step(now, edges, "HAS_CLAUSE", "clause").select("scope", "law", "section", "clause", F.col("clause").alias("at"))
    return G.step(now, edges, "REFERENCES", "refers_to", optional=True).select(F.col("scope").alias("doc_id"), "law", "section", "clause", "refers_to")


def traversal_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The 500 nearest nodes that each law reaches within four steps."""
    edges = edge_rows(spark, d)
    return S.nodes_within(vectors.reach(edges, law_starts(edges), 4), 500)


def knn_floor(spark: SparkSession, d: str) -> DataFrame:
    """Of every row whose id is divisible by 50, the ten nearest of the same label and a cosine of 0.2 or more (the test vectors are
    random; the specification says 0.55)."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return vectors.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10, least=0.2, version="label")


def revisions_asof(spark: SparkSession, d: str) -> DataFrame:
    """The text of each page as of the first of July 2024: its first revision's, or that of the last one before."""
    rows = table(spark, d, "documents", "doc_id", "page_id", "parent_doc_id", "revised_at", "text").withColumn("revised_at", F.col("revised_at").cast("timestamp_ntz"))
    first = rows.where("parent_doc_id is null").groupBy("page_id").agg(F.min_by("text", F.struct("revised_at", "doc_id")).alias("text"))
    later = rows.where("parent_doc_id is not null").select("page_id", "text", F.col("revised_at").alias("effective_at"))
    return S.effective_text(first, later, "page_id", "text", ntz(BEFORE)).select("page_id", F.length("text").alias("n_chars"), "amended_at")


def search_titles(spark: SparkSession, d: str) -> DataFrame:
    """For the title of every document whose id is divisible by 50, the ten documents of its source that hold most of it."""
    rows = table(spark, d, "documents", "doc_id", "title", "text", "source")
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "source", F.col("title").alias("query"))
    return S.full_text(asked, rows.select(F.col("doc_id").alias("row_id"), "source", "text"), "source")


def history_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "revised_at", "editor").withColumn("revised_at", F.col("revised_at").cast("timestamp_ntz"))
    from datetime import datetime

    return S.page_after(rows, "revised_at", "doc_id", (datetime(2024, 7, 1), 0), 50)


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_of(table(spark, d, "documents", "doc_id", "source", "revised_at"), "source", "revised_at", "doc_id")


def duplicate_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Texts that one source has stored several times, by hash."""
    return S.duplicates_by_owner(table(spark, d, "documents", "doc_id", "source", "text"), "source", "doc_id", "text")


def import_diff(spark: SparkSession, d: str) -> DataFrame:
    """What the sections that arrived after the first of July 2024 change in those before."""
    columns = ["title", "text", "level", "parent_section_id"]
    rows = table(spark, d, "sections", "doc_id", "section_id", *columns, "ingested_at", "deleted_at")
    state = lambda df: latest(df, ["doc_id", "section_id"], "ingested_at").where("deleted_at is null")
    return S.import_diff(state(rows.where(F.col("ingested_at") <= ntz(BEFORE))), state(rows), ["doc_id", "section_id"], columns)


def log_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return S.log_page(rows, "ts", "event_id", "2024-01-01 00:00:00", "2024-01-31 00:00:00", {"event_type": "error"}, None, 100)


def graph_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    edges = edge_rows(spark, d)
    return S.neighbourhood(edges, law_starts(edges), 2).withColumn("nodes", F.array_join("nodes", ","))


def purge_due(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "cleaned", "doc_id", "uploaded_at", "ingested_at"), ["doc_id"], "ingested_at")
    return S.due(rows, "uploaded_at", 365, ntz("2025-06-01 00:00:00")).select("doc_id")


def rolling_uploads(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "cleaned", "doc_id", "document_format", "uploaded_at", "ingested_at"), ["doc_id"], "ingested_at")
    return S.rolling_counts(rows, "document_format", "uploaded_at")


def knowledge(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Documents and entities as stored; obligations, one in 50 embeddings, with what they need by their label; matches and
    patterns of clauses and references by the same rule."""
    ob = table(spark, d, "embeddings", "vec_id", "label").where("vec_id % 50 = 0").select(F.col("vec_id").alias("obligation"), "label")
    need = F.when(F.col("label") % 3 == 0, '{"requires_entity":"ORGANIZATION"}').when(F.col("label") % 3 == 1, '{"document_type_in":["pdf","html"]}')
    kinds = F.array(*[F.lit(x) for x in ("pdf", "docx", "txt", "html")])
    n = F.length("clause_text")
    clauses = clause_rows(spark, d).where("clause_text is not null").select("doc_id", "clause_id", (n % 10).alias("key"), ((n % 60 + 40) / 100).alias("score"))
    refs = table(spark, d, "clause_refs", "doc_id", "reference_type").where("reference_type = 'section'").select("doc_id").distinct()
    few = F.broadcast(ob.select("obligation", (F.col("label") % 10).alias("key")))
    return {
        "documents": latest(table(spark, d, "cleaned", "doc_id", "document_format", "ingested_at"), ["doc_id"], "ingested_at").select("doc_id", F.col("document_format").alias("document_type")),
        "entities": table(spark, d, "entities", "doc_id", "entity_type"),
        "obligations": ob.select("obligation", F.concat(F.lit("F"), F.col("label") % 4).alias("framework"), need.alias("applies_if"), "label"),
        "profiles": ob.select(kinds[F.pmod("label", F.lit(4)).cast("int")].alias("document_type"), "obligation"),
        "required": ob.where("label % 3 = 0").select("obligation", F.lit("ORGANIZATION").alias("entity_type")),
        "links": ob.select("obligation", (F.col("obligation") + 50).alias("related")).join(ob.select(F.col("obligation").alias("related")), "related", "left_semi").select("obligation", "related"),
        "matches": clauses.join(few, "key").select("doc_id", "obligation", "clause_id", "score"),
        "patterns": refs.withColumn("label", F.explode(F.array(F.lit(0), F.lit(5)))).join(ob, "label").select("doc_id", "obligation", F.lit(0.9).alias("pattern_score")),
        "penalties": ob.select("obligation", F.concat(F.lit("P"), "label").alias("penalty")),
        "cases": ob.select("obligation", F.concat(F.lit("C"), F.col("label") % 7).alias("case")),
        "superseded": ob.where("label % 7 = 3").select(F.concat(F.lit("C"), F.col("label") % 7).alias("case")),
    }


def finding_rows(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    k = knowledge(spark, d)
    found = G.related(G.seeds(k["documents"], k["profiles"], k["entities"], k["required"]), k["links"])
    told = G.coverage(G.fused(G.applicable(found, k["obligations"], k["documents"], k["entities"]), k["matches"]), k["patterns"])
    return told.join(k["obligations"].select("obligation", "framework"), "obligation"), k


def findings(spark: SparkSession, d: str) -> DataFrame:
    told, k = finding_rows(spark, d)
    told = G.attached(told, k["penalties"], "obligation", "penalty", "penalties", ["MISSING", "PARTIALLY_SATISFIED"])
    told = G.attached(told, k["cases"], "obligation", "case", "cases", but=k["superseded"])
    return told.select("doc_id", "obligation", "framework", "linked", "applies", "clause_id", F.round("coverage_score", 6).alias("coverage_score"), "status", F.array_join("penalties", ",").alias("penalties"), F.array_join("cases", ",").alias("cases"))


def applicable_frameworks(spark: SparkSession, d: str) -> DataFrame:
    return G.frameworks(finding_rows(spark, d)[0])


def missing_obligations(spark: SparkSession, d: str) -> DataFrame:
    told, k = finding_rows(spark, d)
    return G.unsupported(told.where("applies").select("doc_id", "obligation", "framework"), k["patterns"], k["matches"])


def answer_faults(spark: SparkSession, d: str) -> DataFrame:
    """The stored clauses taken as answers, whose citations are the stored references of the clause."""
    refs = table(spark, d, "clause_refs", "doc_id", "clause_id", "reference_text").groupBy("doc_id", "clause_id").agg(F.collect_set("reference_text").alias("citations"))
    rows = clause_rows(spark, d).join(refs, ["doc_id", "clause_id"], "left").withColumn("status", F.when(F.length("section_id") % 2 == 0, "SATISFIED").otherwise("MISSING"))
    return G.answer_faults(rows, "clause_text", "citations", "status", PHRASES).select("doc_id", "clause_id", F.array_join("faults", ",").alias("faults"))


def section_batches(spark: SparkSession, d: str) -> DataFrame:
    return G.by_section(clause_rows(spark, d), ["doc_id", "section_id"], ["clause_id", "ord"], "ord")


def fallback_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = clause_rows(spark, d)
    return rows.select("doc_id", "clause_id", G.fallback_text(F.col("section_title"), F.col("doc_id"), F.col("section_id"), F.lit("PARTIALLY_SATISFIED"), F.lit("See the law.")).alias("text"))


def queries() -> dict:
    every = (
        page_routes, merged_clauses, taxonomy_tags, typed_expansion, traversal_nodes, knn_floor, revisions_asof, search_titles, history_page, dashboard, duplicate_uploads, import_diff, log_page, graph_neighbourhood,
        purge_due, rolling_uploads, findings, applicable_frameworks, missing_obligations, answer_faults, section_batches, fallback_texts,
    )
    return {f.__name__: f for f in every}


EDGES = """e AS (SELECT DISTINCT doc_id, source, target, type FROM (SELECT doc_id, ord, source, target, rel_type AS type FROM edges QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY ingested_at DESC) = 1) WHERE source IS NOT NULL AND target IS NOT NULL),
      laws AS (SELECT DISTINCT doc_id, source AS start FROM e WHERE starts_with(source, 'law_'))"""
STORED = "docs AS (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1)"
KNOWLEDGE = f"""{CLAUSES}, {STORED},
      ob AS (SELECT vec_id AS obligation, label, 'F' || (label % 4) AS framework FROM embeddings WHERE vec_id % 50 = 0),
      typed AS (SELECT doc_id, document_format AS document_type FROM docs),
      seed AS (SELECT doc_id, obligation FROM typed JOIN ob ON document_type = (['pdf', 'docx', 'txt', 'html'])[label % 4 + 1]
        UNION SELECT doc_id, obligation FROM (SELECT DISTINCT doc_id FROM entities WHERE entity_type = 'ORGANIZATION') JOIN ob ON label % 3 = 0),
      cand AS (SELECT *, FALSE AS linked FROM seed UNION ALL SELECT DISTINCT s.doc_id, o.obligation, TRUE FROM seed s JOIN ob o ON o.obligation = s.obligation + 50 WHERE NOT EXISTS (SELECT 1 FROM seed t WHERE t.doc_id = s.doc_id AND t.obligation = o.obligation)),
      app AS (SELECT c.*, o.framework, o.label, CASE o.label % 3 WHEN 0 THEN EXISTS (SELECT 1 FROM entities n WHERE n.doc_id = c.doc_id AND n.entity_type = 'ORGANIZATION') WHEN 1 THEN t.document_type IN ('pdf', 'html') ELSE TRUE END AS applies
        FROM cand c JOIN ob o USING (obligation) JOIN typed t USING (doc_id)),
      matches AS (SELECT doc_id, obligation, clause_id, (length(clause_text) % 60 + 40) / 100.0::DOUBLE AS score FROM c JOIN ob ON length(clause_text) % 10 = label % 10 WHERE clause_text IS NOT NULL),
      pats AS (SELECT DISTINCT doc_id, obligation FROM clause_refs, ob WHERE reference_type = 'section' AND label IN (0, 5)),
      best AS (SELECT doc_id, obligation, min((-score, clause_id)) AS b FROM matches WHERE score >= 0.55 GROUP BY ALL),
      told AS (SELECT a.*, b.b[2] AS clause_id, greatest(-b.b[1], CASE WHEN p.doc_id IS NOT NULL THEN 0.9 END) AS cs FROM app a LEFT JOIN best b USING (doc_id, obligation) LEFT JOIN pats p USING (doc_id, obligation)),
      found AS (SELECT *, CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN cs >= 0.8 THEN 'SATISFIED' WHEN cs >= 0.55 THEN 'PARTIALLY_SATISFIED' ELSE 'MISSING' END AS status FROM told)"""


def oracle_sql() -> dict[str, str]:
    sentence = f"regexp_matches(regexp_replace(coalesce(clause_text, ''), '\\A[{SP}]+|[{SP}]+\\z', '', 'g'), '[.!?][)\\]\"''”’»]*\\z')"
    tags = ", ".join(f"({k}, {q(a)}, {q(b)})" for k, (a, b) in enumerate(TAXONOMY))
    conflict = " OR ".join(f"(contains(lower(clause_text), {q(p)}) AND status <> {q(s)})" for p, s in PHRASES.items())
    tidy = "lower(regexp_replace(x, '\\s+', ' ', 'g'))"
    words = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
    cut = f"TIMESTAMP '{BEFORE}'"
    state = lambda where: f"SELECT * FROM (SELECT * FROM sections WHERE {where} QUALIFY row_number() OVER (PARTITION BY doc_id, section_id ORDER BY ingested_at DESC) = 1) WHERE deleted_at IS NULL"
    differs = "concat_ws(',', " + ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in ("title", "text", "level", "parent_section_id")) + ")"
    return {
        "page_routes": f"WITH {STORED} SELECT doc_id, CASE WHEN cleaned_text IS NULL THEN 'UNREADABLE' WHEN length(cleaned_text) / CASE WHEN page_count > 0 THEN page_count ELSE 1 END < 2000 THEN 'OCR_FALLBACK' ELSE 'NATIVE_TEXT' END AS route FROM docs",
        "merged_clauses": f"""WITH {CLAUSES}, u AS (SELECT doc_id, ord, arg_min(coalesce(clause_text, chr(1)), clause_id) AS t FROM c GROUP BY ALL),
      w AS (SELECT doc_id, ord, nullif(t, chr(1)) AS clause_text FROM u), f AS (SELECT *, {sentence} AS whole FROM w),
      n AS (SELECT *, greatest(sum(whole::INT) OVER (PARTITION BY doc_id ORDER BY ord), 1) - 1 AS no FROM f)
      SELECT doc_id, no::INT AS unit_no, min(ord) AS first_ord, max(ord) AS last_ord, string_agg(coalesce(clause_text, ''), ' ' ORDER BY ord) AS text FROM n GROUP BY doc_id, no""",
        "taxonomy_tags": f"""WITH {CLAUSES}, {spans_cte([r"(?i)\b" + t + r"\b" for _, t in TAXONOMY])}, tags(pattern_no, tag, term) AS (VALUES {tags})
      SELECT doc_id, clause_id, tag, term, s AS span_start, s + length(t) AS span_end, t AS span_text FROM spans JOIN tags USING (pattern_no)""",
        "typed_expansion": f"""WITH {EDGES} SELECT l.doc_id, l.start AS law, a.target AS section, b.target AS clause, r.target AS refers_to FROM laws l JOIN e a ON a.doc_id = l.doc_id AND a.source = l.start AND a.type = 'HAS_SECTION'
      JOIN e b ON b.doc_id = l.doc_id AND b.source = a.target AND b.type = 'HAS_CLAUSE' LEFT JOIN e r ON r.doc_id = l.doc_id AND r.source = b.target AND r.type = 'REFERENCES'""",
        "traversal_nodes": f"""WITH RECURSIVE {EDGES}, r(doc_id, start, node, hops) AS (SELECT e.doc_id, start, target, 1 FROM laws JOIN e ON e.doc_id = laws.doc_id AND e.source = start UNION SELECT r.doc_id, r.start, e.target, r.hops + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.source = r.node WHERE r.hops < 4)
      SELECT doc_id, start, node, hops FROM (SELECT doc_id, start, node, min(hops) AS hops FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY hops, node) <= 500""",
        "knn_floor": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE score >= 0.2) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
        "revisions_asof": f"""WITH f AS (SELECT page_id, first(coalesce(text, chr(1)) ORDER BY revised_at, doc_id) AS t FROM documents WHERE parent_doc_id IS NULL GROUP BY ALL),
      a AS (SELECT page_id, max((revised_at, coalesce(text, ''))) AS m, arg_max(coalesce(length(text), -1), (revised_at, coalesce(text, ''))) AS n FROM documents WHERE parent_doc_id IS NOT NULL AND revised_at <= {cut} GROUP BY ALL)
      SELECT f.page_id, nullif(CASE WHEN a.page_id IS NOT NULL THEN n WHEN t = chr(1) THEN -1 ELSE length(t) END, -1) AS n_chars, m[1] AS amended_at FROM f LEFT JOIN a ON a.page_id = f.page_id""",
        "search_titles": f"""WITH q AS (SELECT doc_id AS query_id, source, unnest({words("substr(title, 1, 256)")}) AS w FROM documents WHERE doc_id % 50 = 0), r AS (SELECT doc_id AS row_id, source, unnest({words("text")}) AS w FROM documents),
      s AS (SELECT query_id, row_id, count(*) AS score FROM q JOIN r USING (source, w) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 10""",
        "history_page": "SELECT doc_id, revised_at, editor FROM documents WHERE revised_at < TIMESTAMP '2024-07-01' OR (revised_at = TIMESTAMP '2024-07-01' AND doc_id < 0) OR revised_at IS NULL ORDER BY revised_at DESC NULLS LAST, doc_id DESC LIMIT 50",
        "dashboard": "SELECT source, doc_id, revised_at, row_number() OVER (PARTITION BY source ORDER BY revised_at DESC NULLS LAST, doc_id DESC) AS rank, count(*) OVER (PARTITION BY source) AS n_rows FROM documents WHERE source IS NOT NULL QUALIFY rank <= 5",
        "duplicate_uploads": "SELECT source, sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
        "import_diff": f"""WITH a AS ({state(f'ingested_at <= {cut}')}), b AS ({state('TRUE')}),
      f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.section_id, b.section_id) AS section_id, a.doc_id IS NULL AS fresh, b.doc_id IS NULL AS gone, {differs} AS fields FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.section_id = b.section_id)
      SELECT doc_id, section_id, CASE WHEN fresh THEN 'add' WHEN gone THEN 'remove' ELSE 'modify' END AS change, CASE WHEN NOT fresh AND NOT gone THEN fields END AS fields FROM f WHERE fresh OR gone OR fields <> ''""",
        "log_page": "SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' ORDER BY ts DESC, event_id DESC LIMIT 100",
        "graph_neighbourhood": f"""WITH {EDGES}, b AS (SELECT doc_id, source AS x, target AS y FROM e UNION SELECT doc_id, target, source FROM e), n1 AS (SELECT l.doc_id, start, y FROM laws l JOIN b ON b.doc_id = l.doc_id AND x = start),
      n AS (SELECT doc_id, start, start AS node FROM laws UNION SELECT * FROM n1 UNION SELECT n1.doc_id, start, b.y FROM n1 JOIN b ON b.doc_id = n1.doc_id AND b.x = n1.y)
      SELECT doc_id, start, count(*) AS n_nodes, count(*) > 150 AS refused, CASE WHEN count(*) <= 150 THEN string_agg(node, ',' ORDER BY node) END AS nodes FROM n GROUP BY ALL""",
        "purge_due": f"WITH {STORED} SELECT doc_id FROM docs WHERE uploaded_at <= TIMESTAMP '2025-06-01' - INTERVAL 365 DAY",
        "rolling_uploads": f"""WITH {STORED}, d AS (SELECT document_format, uploaded_at::DATE AS day, count(*) AS n FROM docs WHERE uploaded_at IS NOT NULL GROUP BY ALL)
      SELECT *, sum(n) OVER (PARTITION BY document_format ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)::BIGINT AS n_rolling FROM d""",
        "findings": f"""WITH {KNOWLEDGE} SELECT doc_id, obligation, framework, linked, applies, clause_id, round(cs, 6) AS coverage_score, status, CASE WHEN status IN ('MISSING', 'PARTIALLY_SATISFIED') THEN 'P' || label ELSE '' END AS penalties, CASE WHEN label % 7 = 3 THEN '' ELSE 'C' || (label % 7) END AS cases FROM found""",
        "applicable_frameworks": f"WITH {KNOWLEDGE} SELECT doc_id, framework, bool_or(status <> 'NOT_APPLICABLE') AS applicable, count(*) AS n_findings, count(*) FILTER (status IN ('MISSING', 'PARTIALLY_SATISFIED')) AS n_open FROM found GROUP BY ALL",
        "missing_obligations": f"WITH {KNOWLEDGE} SELECT doc_id, obligation, framework FROM found WHERE applies AND cs IS NULL",
        "answer_faults": f"""WITH {CLAUSES}, r AS (SELECT doc_id, clause_id, list(DISTINCT reference_text) AS citations FROM clause_refs WHERE reference_text IS NOT NULL GROUP BY ALL),
      a AS (SELECT c.*, r.citations, CASE WHEN length(section_id) % 2 = 0 THEN 'SATISFIED' ELSE 'MISSING' END AS status FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND r.clause_id = c.clause_id)
      SELECT doc_id, clause_id, concat_ws(',', CASE WHEN clause_text IS NULL THEN 'missing' END,
        CASE WHEN len(list_filter(list_transform(regexp_extract_all(clause_text, '(?i)section\\s+\\d+(?:\\.\\d+)*[A-Z]?'), lambda x: {tidy}), lambda y: NOT list_contains(list_transform(coalesce(citations, []::VARCHAR[]), lambda x: {tidy}), y))) > 0 THEN 'unknown_citation' END,
        CASE WHEN {conflict} THEN 'status_conflict' END,
        CASE WHEN len(list_filter(string_split(regexp_replace(trim(clause_text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) > 4 THEN 'too_long' END,
        CASE WHEN regexp_matches(clause_text, '(?m)^\\s*(?:#{{1,6}}\\s|[-*]\\s|\\d+\\.\\s)|\\*\\*|`|\\[[^\\]]*\\]\\(') THEN 'markdown' END) AS faults FROM a""",
        "section_batches": f"""WITH {CLAUSES} SELECT doc_id, section_id, count(*) AS n, '[' || string_agg('{{"clause_id":"' || clause_id || '","ord":' || ord || '}}', ',' ORDER BY ord, clause_id) || ']' AS findings FROM c GROUP BY ALL""",
        "fallback_texts": f"""WITH {CLAUSES} SELECT doc_id, clause_id, concat_ws(' ', '"' || section_title || '"', 'under', doc_id, section_id, 'is currently', 'partially satisfied', 'based on this document.', 'See the law.') AS text FROM c""",
    }
