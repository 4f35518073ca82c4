import json

import pytest

from pyspark.sql import functions as F

from lexmill.operators import classify as K
from lexmill import cli
from lexmill.operators import enrich, graph, vectors
from lexmill.plans import pipeline
from lexmill.sinks import graph_store
from lexmill.streaming import ingest
from tests.test_documents import rows

SCHEMA = "doc_id string, ord int, clause_id string, section_id string, section_title string, clause_text string"


def build(spark, *sections):
    """Sections are (title, texts)."""
    out = [("D", i * 10 + j, f"S{i:03d}_C{j:03d}", f"S{i:03d}", t, x) for i, (t, xs) in enumerate(sections, 1) for j, x in enumerate(xs, 1)]
    c = spark.createDataFrame(out, SCHEMA)
    docs = spark.createDataFrame([("D", "Act"), ("E", "Empty")], "doc_id string, title string")
    nodes, edges = graph.hierarchy(c, docs)
    return c, nodes, edges


def test_hierarchy(spark):
    c, nodes, edges = build(spark, ("CHAPTER 1: Intro", ["a"]), ("1. Scope", ["b", "c"]), ("1.1 Detail", ["d"]), (None, ["e"]), ("Part II", ["f"]))
    assert rows(edges.where("type <> 'HAS_CLAUSE'"), "source", "target", "type") == sorted([
        ("law_D", "chapter_S001", "HAS_CHAPTER"),
        ("chapter_S001", "section_S002", "HAS_SECTION"),
        ("section_S002", "subsection_S003", "HAS_SUBSECTION"),
        ("chapter_S001", "section_S004", "HAS_SECTION"),
        ("law_D", "chapter_S005", "HAS_CHAPTER"),
    ])
    assert ("subsection_S003", "clause_S003_C001") in rows(edges, "source", "target")
    assert nodes.where("id = 'chapter_S001'").first().properties == {"number": "1", "title": "CHAPTER 1: Intro"}
    assert nodes.select("doc_id").distinct().count() == 1
    targets = [r[0] for r in rows(edges, "target")]
    assert len(targets) == len(set(targets)) == nodes.count() - 1


def test_resolution(spark):
    c, nodes, edges = build(spark, ("Chapter II", ["see Part II and article 4 and section 4 and Section 99"]), ("4. Rules", ["Clause (a) and Rule 7, subsection (2)", "the Proviso"]), ("4.1 (2) Sub", ["this Act and section 4"]), ("Proviso terms", ["section 4 section 4"]))
    res = graph.resolve(nodes, c, K.references(c))
    got = {(r.clause_id, r.ref_text): r.target for r in res.collect()}
    assert got[("S001_C001", "Part II")] == "chapter_S001" and got[("S001_C001", "article 4")] == "section_S002" and got[("S001_C001", "section 4")] == "section_S002"
    assert got[("S001_C001", "Section 99")] is None and got[("S002_C001", "Clause (a)")] is None and got[("S002_C001", "Rule 7")] is None
    assert got[("S002_C001", "subsection (2)")] == "subsection_S003" and got[("S002_C002", "Proviso")] == "section_S004" and got[("S003_C001", "this Act")] is None
    n, e = graph.link(nodes, edges, res)
    assert e.where("source = 'clause_S004_C001' and type = 'REFERENCES'").count() == 1
    assert n.where("label = 'UnresolvedReference'").count() == e.where("type = 'UNRESOLVED_REFERENCE'").count() > 0
    assert "unresolved_S001_C001_section_99" in [r[0] for r in rows(n, "id")]


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame([("D", k, *x, None) for k, x in enumerate(nodes)], "doc_id string, ord int, id string, label string, properties map<string,string>, source_clause string")
    e = spark.createDataFrame([("D", k, *x, {}) for k, x in enumerate(edges)], "doc_id string, ord int, source string, target string, type string, properties map<string,string>")
    return n, e


def test_violations(spark):
    n, e = graph_of(spark, [("a", "Section", {"x": "1"}), ("a", "Section", {"x": "1"}), ("b", "Nope", {"x": "1"}), ("c", "Clause", {}), ("d", "Clause", None)], [("a", "z", "REFERENCES"), ("z", "a", "REFERENCES"), ("a", "a", "USES"), ("a", "b", "NOPE"), (None, "a", "USES")])
    got = [r[0] for r in rows(graph.violations(n, e, spark.createDataFrame([("D",), ("X",)], "doc_id string")), "rule")]
    assert got == ["dangling_source", "dangling_source", "dangling_target", "duplicate_id", "empty_graph", "empty_properties", "empty_properties", "self_loop", "unknown_label", "unknown_type"]


def test_cypher_and_export(spark):
    n, e = graph_of(spark, [("a", "LawVersion", {"t": 'q"uote'}), ("b", "Bad label", {"x": "1"})], [("a", "b", "HAS_SECTION")])
    got = graph.cypher(n, e).orderBy("part", "no").collect()
    assert got[0].query == "MERGE (n:LawVersion {id: $n0_id}) SET n += $n0_props" and json.loads(got[0].parameters) == {"n0_id": "a", "n0_props": {"t": 'q"uote', "id": "a"}}
    assert got[1].error is not None and got[2].query.endswith("MERGE (source)-[r:HAS_SECTION]->(target) SET r += $r0_props")
    n2, e2 = graph.exported(n, e)
    assert rows(n2, "label") == [("Bad label",), ("Document",)] and rows(e2, "type") == [("CONTAINS",)]
    assert graph.stats(n, e).first().asDict() == {"doc_id": "D", "nodes_in_ir": 2, "relationships_in_ir": 1}
    assert rows(graph.upsert(n, n2.where("id = 'a'"), ["doc_id", "id"]), "id", "label") == [("a", "Document"), ("b", "Bad label")]


def test_enrichment(spark):
    def model(system, user):
        if "bad" in user:
            return "oops"
        if "none" in user:
            return '{"obligations": []}'
        return '{"obligations": [{"subject": "s", "action": "a", "object": "o", "condition": "", "exception": null}, {"subject": "t"}]}'

    c, nodes, edges = build(spark, ("1. X", ["one", "bad", "none", "two"]))
    n, e, failed = enrich.enrich(nodes, edges, model)
    assert rows(n.where("label = 'Obligation'"), "id") == [(f"obl_clause_S001_C00{c}_{k}",) for c, k in ((1, 0), (1, 1), (4, 2), (4, 3))]
    assert e.where("type = 'HAS_OBLIGATION'").count() == 4 and rows(failed, "id", "error") == [("clause_S001_C002", "Invalid JSON from LLM")]
    answers = ["", None, "[1]", '{"x": 1}', '{"obligations": 3}', '{"obligations": [3]}', '{"obligations": [{"subject": 3}]}', '{"obligations": [{"condition": 3}]}']
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, answer string")
    assert all(r.error and r.obligations is None for r in enrich.read_obligations(df).collect())


def test_graph_answers(spark):
    good = '```json\n{"nodes": [{"id": " a ", "label": "Section", "properties": {"x": "1"}}], "relationships": []}\n```'
    df = spark.createDataFrame([("D", good), ("E", ""), ("F", "{"), ("G", "{}"), ("H", '{"nodes": [{"id": "", "label": "x"}], "relationships": []}')], "doc_id string, answer string")
    n, e, failed = enrich.read_graphs(df)
    assert rows(n, "doc_id", "id") == [("D", "a")] and e.count() == 0 and [r[0] for r in rows(failed, "doc_id")] == ["E", "F", "G", "H"]
    assert json.loads(enrich.graph_json(n, e).first().graph_json)["nodes"][0]["id"] == "a"
    assert "Clause" in enrich.graph_prompt()


def test_pipeline_end_to_end(spark, tmp_path):
    text = "1. Scope\n\nThe Data Fiduciary shall protect personal data.\n\n4. Notice\n\nAs required under Section 4, the Data Fiduciary shall give notice within 30 days."
    docs = spark.createDataFrame([("D", text), ("N", None), ("E", "")], "doc_id string, raw_text string")
    out = pipeline.run(docs)
    assert {"Data Fiduciary", "personal data", "Section 4"} <= {r[0] for r in rows(out.entities, "entity_text")}
    assert out.chunks.count() == 2
    seen = {r.doc_id: json.loads(r.preview) for r in pipeline.preview(out).collect()}
    assert set(seen) == {"D", "E"} and [s["section_id"] for s in seen["D"]["sections"]] == ["S001", "S002"] and seen["E"]["clauses"] == []
    pipeline.write_previews(pipeline.preview(out), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["D.json", "E.json"]
    nodes, edges = pipeline.knowledge_graph(docs.withColumn("title", F.lit("T")), out.clauses, out.references)
    assert ("clause_S002_C001", "section_S002", "REFERENCES") in rows(edges, "source", "target", "type")


def test_streaming_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1. Scope\n\nThe court shall decide.")
    seen = []
    q = ingest.files_to_chunks(spark, str(tmp_path / "in"), lambda df, k: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.text for r in seen] == ["The court shall decide."]


def test_nearest_and_reach(spark):
    v = spark.createDataFrame([(k, [float(k % 3), float(k % 2)]) for k in range(12)] + [(12, None)], "id long, v array<float>")
    got = vectors.nearest(v.where("id < 3"), v, "id", "v", 2)
    assert rows(got.where("query_id = 1"), "rank", "id", "score") == [(1, 7, 1.0), (2, 5, 0.94868)]
    assert vectors.nearest(v.where("id > 99"), v, "id", "v", 2).count() == 0
    e = spark.createDataFrame([("D", "a", "b"), ("D", "b", "c"), ("D", "c", "a"), ("D", "a", "c"), ("E", "b", "x")], "doc_id string, source string, target string")
    s = spark.createDataFrame([("D", "a")], "doc_id string, start string")
    assert rows(vectors.reach(e, s, 4), "node", "hops") == [("a", 2), ("b", 1), ("c", 1)]


def fake_store(log, refuse=""):
    """A connection whose statements go to a file a call; a statement that holds `refuse` fails."""

    def connect():
        import json
        import os
        import uuid
        from types import SimpleNamespace as N

        if refuse == "connect":
            raise OSError("no route")

        class Session:
            lines = []

            def __enter__(self):
                return self

            def __exit__(self, *_):
                return False

            def run(self, query, parameters):
                if refuse and refuse in query + json.dumps(parameters) and not (refuse == "late" and query.startswith("EXPLAIN")):
                    raise ValueError("refused")
                self.lines.append([query, parameters])
                made = N(nodes_created=int(query.startswith("MERGE")), relationships_created=int(query.startswith("MATCH")))
                return N(consume=lambda: N(counters=made))

            def execute_write(self, work):
                before = len(self.lines)
                try:
                    out = work(self)
                except Exception:
                    del self.lines[before:]
                    raise
                with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                    json.dump(self.lines, f)
                self.lines.clear()
                return out

        return N(session=lambda **_: Session(), close=lambda: open(os.path.join(log, "closed"), "w").close())

    return connect


def good_graph(spark):
    n = spark.createDataFrame([(d, k, i, "Section", {"x": "1"}, None) for d in "DE" for k, i in enumerate(("a", "b"))], "doc_id string, ord int, id string, label string, properties map<string,string>, source_clause string")
    e = spark.createDataFrame([(d, 0, "a", "b", "REFERENCES", {}) for d in "DE"], "doc_id string, ord int, source string, target string, type string, properties map<string,string>")
    return n, e


def test_load_into_a_store(spark, tmp_path):
    n, e = good_graph(spark)
    got = {r.doc_id: r for r in graph_store.load(graph.cypher(n, e), fake_store(str(tmp_path))).collect()}
    assert all((r.nodes_created, r.relationships_created, r.error) == (2, 1, None) for r in got.values()) and set(got) == {"D", "E"}
    runs = [json.loads(p.read_text()) for p in tmp_path.iterdir() if p.name != "closed"]
    assert len(runs) == 2 and (tmp_path / "closed").exists()
    for lines in runs:
        kinds = [q.split(" ")[0] for q, _ in lines]
        assert kinds == ["EXPLAIN"] * 3 + ["MERGE", "MERGE", "MATCH"]
    for refuse, said in (("EXPLAIN", "EXPLAIN failed"), ("connect", "Failed to connect: no route")):
        assert all(said in r.error and r.nodes_created == 0 for r in graph_store.load(graph.cypher(n, e), fake_store(str(tmp_path), refuse)).collect())


def test_a_failed_transaction_leaves_nothing(spark, tmp_path):
    n, e = good_graph(spark)
    e = e.withColumn("properties", F.when(F.col("doc_id") == "E", F.create_map(F.lit("x"), F.lit("late"))).otherwise(F.col("properties")))
    got = {r.doc_id: (r.nodes_created, r.relationships_created, r.error) for r in graph_store.export(n, e, fake_store(str(tmp_path), "late")).collect()}
    assert got == {"D": (2, 1, None), "E": (0, 0, "refused")}
    assert len([p for p in tmp_path.iterdir() if p.name != "closed"]) == 1


def test_build_of_graphs_and_answers(spark, tmp_path):
    n, e = good_graph(spark)
    n = n.withColumn("label", F.when((F.col("doc_id") == "E") & (F.col("id") == "b"), "Nope").otherwise(F.col("label")))
    docs = spark.createDataFrame([("D",), ("E",), ("X",)], "doc_id string")
    got = {r.doc_id: r for r in graph_store.build_from_graphs(n, e, docs, fake_store(str(tmp_path))).collect()}
    assert (got["D"].nodes_created, got["D"].relationships_created, got["D"].nodes_in_ir, got["D"].error) == (2, 1, 2, None)
    assert (got["E"].error, got["E"].nodes_created, got["X"].error, got["X"].nodes_in_ir) == ("unknown_label b", 0, "empty_graph", 0)
    assert graph_store.build_from_graphs(n, e, docs).where("doc_id = 'D'").first().nodes_created == 0

    def model(system, user):
        return '{"nodes": [{"id": "a", "label": "Section", "properties": {"x": 1}}], "relationships": []}' if "good" in user else "{"

    prompts = spark.createDataFrame([("D", "s", "good"), ("E", "s", "bad")], "doc_id string, system string, user string")
    got = {r.doc_id: (r.nodes_in_ir, r.nodes_created, r.error) for r in graph_store.build(prompts, model, fake_store(str(tmp_path))).collect()}
    assert got == {"D": (1, 1, None), "E": (0, 0, "Invalid JSON")}


def test_graph_answers_are_checked_strictly(spark):
    node = lambda **k: json.dumps({"nodes": [{"id": "a", "label": "Section"} | k], "relationships": []})
    rel = lambda **k: json.dumps({"nodes": [], "relationships": [{"source": "a", "target": "b", "type": "USES"} | k]})
    good = [node(extra=3), node(properties={}), node(source_clause=None), rel(properties={"k": "v"}), node(properties={"n": 3})]
    bad = ["[]", '{"nodes": {}, "relationships": []}', '{"nodes": []}', '{"nodes": [3], "relationships": []}', node(id=3), node(label=" "), node(properties=[1]), node(source_clause=7), rel(type=None), rel(source=1), rel(properties="x")]
    df = spark.createDataFrame([(f"{k:02d}", a) for k, a in enumerate([*good, *bad])], "doc_id string, answer string")
    n, e, failed = enrich.read_graphs(df)
    assert [r[0] for r in rows(failed, "doc_id")] == [f"{k:02d}" for k in range(len(good), len(good) + len(bad))]
    assert {r.doc_id: r.properties for r in n.collect()} == {"00": {}, "01": {}, "02": {}, "04": {"n": "3"}} and e.count() == 1


def test_document_json_and_prompts(spark):
    docs = spark.createDataFrame([("D", 'A "title"', "1. Scope\n\nThe court shall decide under Section 4.\n\nIt may ask."), ("N", "Nothing", None)], "doc_id string, title string, raw_text string")
    out = pipeline.run(docs)
    got = {r.doc_id: json.loads(r.document_json) for r in enrich.document_json(docs, out.context, out.entities, out.references).collect()}
    assert got["D"]["document"] == {"document_id": "D", "filename": None, "format": None, "title": 'A "title"'} and got["N"]["clauses"] == []
    first, second = got["D"]["clauses"]
    assert first["text"] == "The court shall decide under Section 4." and [x["entity_text"] for x in first["entities"]] == ["court", "Section 4"]
    assert first["references"] == [{"reference_text": "Section 4", "reference_type": "section", "resolved": False, "resolved_clause_id": None, "resolved_section_id": None}]
    assert second["references"] == [] and second["context"]["previous_clause_id"] == first["clause_id"] and second["context"]["is_last_in_section"]
    prompt = enrich.graph_prompts(enrich.document_json(docs, out.context, out.entities, out.references)).where("doc_id = 'D'").first()
    assert "Section 4" in prompt.user and "Labels: Actor," in prompt.system


def test_steps_can_be_replaced(spark):
    docs = spark.createDataFrame([("D", "== One\nfirst; second\n== Two\nthird of the words here")], "doc_id string, raw_text string")
    split = lambda df, keys: df.select(*keys, F.posexplode(F.split("text", "; ")).alias("unit_no", "unit_text")).select("*", F.lit(0).alias("start_char"), F.length("unit_text").alias("end_char"), F.lit(None).cast("string").alias("clause_number"))
    heading = lambda s, before, after: F.when(F.startswith(s, F.lit("== ")), F.struct(F.lit("own").alias("style"), F.lit(1).alias("level"), F.substring(s, 4, 99).alias("title")))
    detect = lambda c, refs: c.select("doc_id", "clause_id", F.lit(0).alias("detector_no"), F.lit(0).alias("pattern_no"), F.lit(0).alias("start_offset"), F.lit(5).alias("end_offset"), F.lit("x").alias("entity_text"), F.lit("PERSON").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit("own").alias("detection_method"))
    role = lambda text, title: F.struct(F.lit("STATEMENT").alias("role"), F.lit(0.1).alias("confidence"), F.array(title).alias("reasons"))
    out = pipeline.run(docs, parts=pipeline.Parts(heading=heading, splitter=split, classifier=role, detectors=[detect], merger=lambda df: df.where("clause_id <> 'S001_C002'"), references=lambda c: K.references(c).where("false")))
    assert rows(out.clauses, "clause_text") == [("first",), ("second",), ("third of the words here",)]
    assert rows(out.sections, "title") == [("One",), ("Two",)] and {r.detection_method for r in out.entities.collect()} == {"own"} and out.entities.count() == 2
    assert {r.confidence for r in out.classified.collect()} == {0.1}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for k in range(23):
        (tmp_path / "in" / f"bad{k}.html").write_text("<p>")
    (tmp_path / "in" / "good.txt").write_text("1. Scope\n\nThe court shall decide.")
    (tmp_path / "in" / "empty.docx").write_bytes(b"")
    assert cli.main(["preview", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 1
    said = capsys.readouterr().err
    assert said.count("Unsupported file type") == 23 and "empty.docx: DOCX file is empty" in said and len(list((tmp_path / "out").glob("*.json"))) == 1
    (tmp_path / "log").mkdir()
    assert cli.main(["export", "--text", "1. Scope\n\nThe court shall decide.", "--uri", "bolt://x"], spark, fake_store(str(tmp_path / "log"))) == 0
    assert "3 nodes, 2 relationships created" in capsys.readouterr().err
    assert cli.main(["export", str(tmp_path / "gone")], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["preview"], spark)
