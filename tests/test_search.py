from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.operators import findings as G
from lexmill.operators import search as S
from lexmill.operators import vectors
from tests.test_documents import rows

DAY = lambda k: datetime(2024, 1, k)


def test_page_routes(spark):
    df = spark.createDataFrame([("a", "x" * 40, 2), ("b", "x" * 39, 2), ("c", None, 2), ("d", "", None), ("e", "x" * 20, 0)], "id string, t string, n int")
    assert rows(S.page_routes(df, "t", 20, F.col("n")), "id", "route") == [("a", "NATIVE_TEXT"), ("b", "OCR_FALLBACK"), ("c", "UNREADABLE"), ("d", "OCR_FALLBACK"), ("e", "NATIVE_TEXT")]


def test_merged_units(spark):
    df = spark.createDataFrame([("D", k, t) for k, t in enumerate(["no end", None, "One.", "tail", "more", "Two!", "(Three.)"])] + [("E", 0, "only"), ("E", 5000, "this")], "doc_id string, ord int, clause_text string")
    got = rows(S.merged_units(df), "doc_id", "unit_no", "first_ord", "last_ord", "text")
    assert got == [("D", 0, 0, 4, "no end  One. tail more"), ("D", 1, 5, 5, "Two!"), ("D", 2, 6, 6, "(Three.)"), ("E", 0, 0, 5000, "only this")]


def test_neighbourhood_and_limits(spark):
    e = spark.createDataFrame([("D", "a", "b"), ("D", "c", "b"), ("D", "c", "d"), ("D", None, "a"), ("E", "a", "z")], "doc_id string, source string, target string")
    s = spark.createDataFrame([("D", "a"), ("D", "a"), ("D", "lone")], "doc_id string, start string")
    got = {r.start: (r.n_nodes, r.refused, r.nodes) for r in S.neighbourhood(e, s, 2).collect()}
    assert got == {"a": (3, False, ["a", "b", "c"]), "lone": (1, False, ["lone"])}
    assert {r.start: (r.refused, r.nodes) for r in S.neighbourhood(e, s, 2, 2).collect()}["a"] == (True, None)
    reached = vectors.reach(e, s.distinct(), 3)
    assert rows(S.nodes_within(reached, 1), "node") == [("b",)]


def test_effective_text(spark):
    o = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None)], "k string, t string")
    m = spark.createDataFrame([("a", "later", DAY(9)), ("a", "soon", DAY(2)), ("a", "tie", DAY(2)), ("b", None, DAY(1)), ("z", "x", DAY(1))], "k string, t string, effective_at timestamp_ntz")
    assert rows(S.effective_text(o, m, "k", "t", F.lit(DAY(5))), "k", "t", "amended_at") == [("a", "tie", DAY(2)), ("b", None, DAY(1)), ("c", None, None)]


def test_full_text_stays_in_its_scope(spark):
    r = spark.createDataFrame([(1, "x", "Red fox runs"), (2, "x", "red RED hen"), (3, "y", "red fox"), (4, None, "red fox"), (5, "x", None)], "row_id long, org string, text string")
    asked = spark.createDataFrame([(1, "x", "red fox red"), (2, "x", ""), (3, None, "red"), (4, "x", None)], "query_id long, org string, query string")
    assert rows(S.full_text(asked, r, "org"), "query_id", "rank", "row_id", "score") == [(1, 1, 1, 2), (1, 2, 2, 1)]
    assert rows(S.full_text(asked, r, "org", k=1), "row_id") == [(1,)]


def test_pages_stay_put(spark):
    given = [(k, DAY(1 + k // 3)) for k in range(10)] + [(99, None)]
    df = spark.createDataFrame(given, "id long, at timestamp_ntz")
    seen, cursor = [], None
    while page := S.page_after(df, "at", "id", cursor, 4).collect():
        seen += [r.id for r in page]
        cursor = (page[-1].at, page[-1].id)
        df = df.unionAll(spark.createDataFrame([(1000 + len(seen), DAY(28))], df.schema))
    assert seen == [9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 99]
    top = S.latest_of(spark.createDataFrame([(g, *x) for g in "ab" for x in given], "g string, id long, at timestamp_ntz"), "g", "at", "id", 2)
    assert rows(top, "g", "rank", "id", "n_rows") == [("a", 1, 9, 11), ("a", 2, 8, 11), ("b", 1, 9, 11), ("b", 2, 8, 11)]


def test_duplicates_diff_and_logs(spark):
    df = spark.createDataFrame([("o", 1, "x"), ("o", 2, "x"), ("p", 3, "x"), (None, 4, "x"), ("o", 5, None), ("o", 6, None)], "owner string, id int, t string")
    assert rows(S.duplicates_by_owner(df, "owner", "id", "t"), "owner", "n", "first_key") == [("o", 2, 1)]
    old = spark.createDataFrame([("a", 1, None), ("b", 1, "x"), (None, 1, "n"), ("same", None, None)], "k string, v int, w string")
    new = spark.createDataFrame([("a", 2, "y"), ("c", 1, "x"), (None, 1, "n"), ("same", None, None)], "k string, v int, w string")
    assert rows(S.import_diff(old, new, ["k"], ["v", "w"]), "k", "change", "fields") == [("a", "modify", "v,w"), ("b", "remove", None), ("c", "add", None)]
    logs = spark.createDataFrame([(k, DAY(1 + k), "error" if k % 2 else "info") for k in range(9)], "id int, ts timestamp_ntz, sev string")
    assert [r.id for r in S.log_page(logs, "ts", "id", "2024-01-02", "2024-01-08", {"sev": "error"}, n=2).collect()] == [5, 3]
    with pytest.raises(ValueError):
        S.log_page(logs, "ts", "id", "2024-01-02", "2024-04-08", {})
    assert rows(S.due(logs, "ts", 3, F.lit(DAY(5))), "id") == [(0,), (1,)]
    assert [r[0] for r in rows(S.rolling_counts(logs, "sev", "ts", 3).where("sev = 'info'"), "n_rolling")] == [1, 2, 2, 2, 2]


def test_taxonomy_and_steps(spark):
    c = spark.createDataFrame([("D", "Health Records and e-mail. healthrecords"), ("E", None)], "id string, clause_text string")
    assert rows(G.taxonomy_entities(c, [("SPDI_CATEGORY", "health records"), ("DATA_TYPE", "e-mail")], ["id"]), "tag", "span_start", "span_text") == [("DATA_TYPE", 19, "e-mail"), ("SPDI_CATEGORY", 0, "Health Records")]
    e = spark.createDataFrame([("D", "o1", "p1", "ENFORCED_BY"), ("D", "o1", "p1", "ENFORCED_BY"), ("D", "s1", "o1", "DEFINES"), ("E", "o2", "p2", "ENFORCED_BY")], "scope string, source string, target string, type string")
    f = spark.createDataFrame([("D", "o1"), ("D", "o2"), (None, "o1")], "scope string, at string")
    assert rows(G.step(f, e, "ENFORCED_BY", "penalty", optional=True).where("scope is not null"), "at", "penalty") == [("o1", "p1"), ("o2", None)]
    assert rows(G.step(f, e, "DEFINES", "section", backward=True), "at", "section") == [("o1", "s1")]


def test_findings(spark):
    docs = spark.createDataFrame([("D", "policy"), ("E", "form")], "doc_id string, document_type string")
    ents = spark.createDataFrame([("D", "SPDI"), ("D", "SPDI"), ("E", None)], "doc_id string, entity_type string")
    profiles = spark.createDataFrame([("policy", 1), ("form", 2)], "document_type string, obligation int")
    required = spark.createDataFrame([(3, "SPDI"), (1, "SPDI")], "obligation int, entity_type string")
    seeds = G.seeds(docs, profiles, ents, required)
    assert rows(seeds, "doc_id", "obligation") == [("D", 1), ("D", 3), ("E", 2)]
    cand = G.related(seeds, spark.createDataFrame([(1, 3), (1, 4), (2, 2)], "obligation int, related int"))
    assert rows(cand, "doc_id", "obligation", "linked") == [("D", 1, False), ("D", 3, False), ("D", 4, True), ("E", 2, False)]
    obligations = spark.createDataFrame([(1, None, "F"), (2, '{"requires_entity":"SPDI"}', "F"), (3, '{"document_type_in":["policy"]}', "G"), (4, "{", "G")], "obligation int, applies_if string, framework string")
    told = G.applicable(cand, obligations, docs, ents)
    assert rows(told, "obligation", "applies") == [(1, True), (2, False), (3, True), (4, False)]
    matches = spark.createDataFrame([("D", 1, "c2", 0.7), ("D", 1, "c1", 0.7), ("D", 3, "c1", 0.5), ("D", 9, "c1", 0.99)], "doc_id string, obligation int, clause_id string, score double")
    scored = G.fused(told, matches)
    assert rows(scored, "obligation", "clause_id", "score") == [(1, "c1", 0.7), (2, None, None), (3, None, None), (4, None, None)]
    found = G.coverage(scored, spark.createDataFrame([("D", 3, 0.85), ("D", 3, 0.1)], "doc_id string, obligation int, pattern_score double"))
    assert rows(found, "obligation", "status") == [(1, "PARTIALLY_SATISFIED"), (2, "NOT_APPLICABLE"), (3, "SATISFIED"), (4, "NOT_APPLICABLE")]
    links = spark.createDataFrame([(1, "p2"), (1, "p1"), (3, "p3")], "obligation int, penalty string")
    assert rows(G.attached(found, links, "obligation", "penalty", "penalties", ["MISSING", "PARTIALLY_SATISFIED"]), "obligation", "penalties") == [(1, ["p1", "p2"]), (2, []), (3, []), (4, [])]
    assert rows(G.attached(found, links, "obligation", "penalty", "p", but=links.where("penalty = 'p1'")), "obligation", "p") == [(1, ["p2"]), (2, []), (3, ["p3"]), (4, [])]
    by = G.frameworks(found.join(obligations.select("obligation", "framework"), "obligation"))
    assert rows(by, "doc_id", "framework", "applicable", "n_findings", "n_open") == [("D", "F", True, 1, 1), ("D", "G", True, 2, 0), ("E", "F", False, 1, 0)]
    assert rows(G.unsupported(found, spark.createDataFrame([("D", 3)], "doc_id string, obligation int"), matches), "obligation") == [(2,), (4,)]


def test_answers(spark):
    df = spark.createDataFrame(
        [(1, "It meets Section 4.", ["section  4"], "SATISFIED"), (2, "See Section 5 and section 4.", ["Section 4"], "MISSING"), (3, "It fully complies.", None, "MISSING"), (4, None, None, "MISSING"), (5, "A. B. C. D. E.", [], "MISSING"), (6, "- a list", [], "MISSING"), (7, "", [], "MISSING")],
        "id int, t string, c array<string>, s string",
    )
    got = {r.id: r.faults for r in G.answer_faults(df, "t", "c", "s", {"fully complies": "SATISFIED"}).collect()}
    assert got == {1: [], 2: ["unknown_citation"], 3: ["status_conflict"], 4: ["missing"], 5: ["too_long"], 6: ["markdown"], 7: []}
    batch = G.by_section(df.withColumn("sec", F.col("id") % 2), ["sec"], ["id"], "id")
    assert rows(batch, "sec", "n", "findings") == [(0, 3, '[{"id":2},{"id":4},{"id":6}]'), (1, 4, '[{"id":1},{"id":3},{"id":5},{"id":7}]')]
    text = df.limit(1).select(G.fallback_text(F.lit("Notice"), F.lit("Act"), F.lit("s. 4"), F.lit("PARTIALLY_SATISFIED"), F.lit(None)).alias("t")).first().t
    assert text == '"Notice" under Act s. 4 is currently partially satisfied based on this document.'


def test_nearest_in_tiles_and_versions(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "TILE", (2, 3))
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(k, [float(x) for x in m[k]], ["a", "b", None][k % 3]) for k in range(40)], "id long, v array<double>, ver string")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    got = {}
    for r in vectors.nearest(df.where("id < 9"), df, "id", "v", 3, least=0.1, version="ver").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for k in range(9):
        own = sorted(((-(u[k] @ u[j]), j) for j in range(40) if j != k and k % 3 < 2 and j % 3 == k % 3 and u[k] @ u[j] >= 0.1))[:3]
        assert sorted(got.get(k, [])) == [(n, j) for n, (_, j) in enumerate(own, 1)]
