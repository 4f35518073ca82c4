import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from lexmill.operators import hierarchy as H
from lexmill.operators import orphans as O
from lexmill.plans import problems
from lexmill.streaming import ingest


def walk(parents):
    """node -> (status, root, depth, ancestors) by following parents."""
    out = {}
    for node in parents:
        up, at = [], node
        while True:
            nxt = parents[at]
            if nxt is None:
                out[node] = ("ok", at, len(up) + 1, up)
                break
            if nxt not in parents:
                out[node] = ("lost_parent" if not up else "below_lost", at, len(up) + 1, up)
                break
            if nxt == node:
                out[node] = ("cycle", None, None, None)
                break
            if nxt in up:
                out[node] = ("below_cycle", None, None, None)
                break
            up = [*up, nxt]
            at = nxt
    return out


@pytest.mark.parametrize("rate", [1, 3, 10_000])
def test_hierarchy_matches_walking(spark, rate):
    random.seed(rate)
    parents = {f"c{k}": f"c{k - 1}" if k else None for k in range(70)}  # a long chain
    parents |= {f"r{k}": random.choice([None, f"r{random.randint(0, 119)}", f"gone{k}"]) if random.random() < 0.2 else f"r{random.randint(0, 119)}" for k in range(120)}
    parents |= {"self": "self", "under": "self", "p": "q", "q": "p", "tail": "under"}
    rows = [("D", n, p, 1) for n, p in parents.items()]
    rows += rows[:20] + [("D", "c5", "c1", 0), ("E", "c5", "c4", 1), ("E", None, "x", 1)]
    df = spark.createDataFrame(rows, "doc string, node string, parent string, at int").withColumnRenamed("at", "g")
    got = H.hierarchy(df, ["doc"], "node", "parent", "g", rate).collect()
    own = {r.node_id: (r.status, r.root_id, r.depth, r.ancestors) for r in got if r.doc == "D"}
    assert own == walk(parents)
    assert [(r.node_id, r.status) for r in got if r.doc == "E"] == [("c5", "lost_parent")]
    paths = {r.node_id: r.path for r in got if r.doc == "D"}
    assert paths["c2"] == "c0/c1/c2" and paths["self"] is None


def test_hierarchy_of_nothing_and_descendants(spark):
    df = spark.createDataFrame([], "doc string, node string, parent string")
    assert H.hierarchy(df, ["doc"], "node", "parent").count() == 0
    df = spark.createDataFrame([("D", "a", None), ("D", "b", "a"), ("D", "c", "b"), (None, "b", "a")], "doc string, node string, parent string")
    tree = H.hierarchy(df, ["doc"], "node", "parent")
    assert sorted((r.node_id, r.descendant_id, r.distance) for r in H.descendants(tree.where("doc = 'D'"), ["doc"]).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert {r.node_id: r.n_descendants for r in H.descendant_counts(tree, ["doc"]).collect()} == {"a": 2, "b": 1}


T0 = datetime(2024, 1, 1)


def reference(ord, key, day, doc="D"):
    return ("edges", "target", doc, ord, "clause", doc, key, T0 + timedelta(days=day))


def parent(key, day, deleted=False, doc="D"):
    return ("clause", doc, key, T0 + timedelta(days=day), deleted)


REF = "table_name string, field_name string, doc_id string, ord int, kind string, owner string, key string, at timestamp_ntz"
PAR = "kind string, owner string, key string, at timestamp_ntz, deleted boolean"


def frames(spark, refs, pars):
    return spark.createDataFrame(refs, REF), spark.createDataFrame(pars, PAR)


def told(df):
    return sorted((r.ord, r.reason) for r in df.collect())


def test_orphans_slice_by_slice(spark):
    refs = [reference(1, "a", 1), reference(1, "a", 9), reference(2, "late", 1), reference(3, "gone", 1), reference(4, "never", 2), reference(5, "back", 1), reference(6, "never", 40, "E")]
    pars = [parent("a", 0), parent("late", 30), parent("gone", 0, True), parent("back", 0, True), parent("back", 35)]
    want = [(2, "late"), (3, "deleted"), (4, "missing"), (6, "missing")]
    for days in ([], [10], [0.5, 5, 20, 31, 36]):
        state, shots = O.replay(*frames(spark, refs, pars), [T0 + timedelta(days=x) for x in days])
        assert told(state.orphans()) == want
        assert len(shots) == len(days) + 1
    # before the late rows came, those references were waiting too
    early = {(r.reason, r.n) for r in O.replay(*frames(spark, refs, pars), [T0 + timedelta(days=10)])[1][0].collect()}
    assert early == {("missing", 2), ("deleted", 2)}
    assert {r.period for r in state.orphans().collect()} == {"2024-01", "2024-02"}


@pytest.mark.parametrize("days", [[], [0.5, 5, 20, 31, 36]])
def test_snapshots_match_replay(spark, days):
    refs = [reference(1, "a", 1), reference(1, "a", 9), reference(2, "late", 1), reference(3, "gone", 1), reference(4, "never", 2), reference(5, "back", 1), reference(6, "never", 40, "E"), reference(7, "back", 33)]
    pars = [parent("a", 0), parent("late", 30), parent("gone", 0, True), parent("back", 0, True), parent("back", 35)]
    both, cuts = frames(spark, refs, pars), [T0 + timedelta(days=x) for x in days]
    plain = lambda df: [(r.table_name, r.field_name, r.period, r.reason, r.n, r.as_of) for r in df.collect()]
    assert sorted(plain(O.snapshots(*both, cuts))) == sorted(x for shot in O.replay(*both, cuts)[1] for x in plain(shot))


def test_snapshots_at_every_month_end(spark, tmp_path):
    random.seed(5)
    day = lambda a, b: T0 + timedelta(days=random.uniform(a, b))
    refs = [(f"clause_{k % 40}", day(0, 330)) for k in range(80)]
    # waits as deleted over one month end only; missing at one, then late
    refs += [("clause_back", datetime(2024, 2, 20)), ("clause_after", datetime(2024, 4, 30, 23, 59, 59, 999999)), ("clause_never", datetime(2024, 5, 1)), ("clause_x", datetime(2024, 12, 3))]
    rows = [(f"{k}", day(0, 330), gone) for k in range(36) for gone in random.choice(([None], [T0], [T0, None]))]
    rows += [("back", datetime(2024, 1, 2), T0), ("back", datetime(2024, 3, 9), None), ("after", datetime(2024, 5, 1), None), ("x", datetime(2025, 2, 1), None)]
    put = lambda name, data, cols: spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    put("edges", [("D", n, key, None, at) for n, (key, at) in enumerate(refs)], "doc_id string, ord int, source string, target string, ingested_at timestamp_ntz")
    put("clauses", [("D", *r) for r in rows], "doc_id string, clause_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    put("clause_refs", [], "doc_id string, ord int, resolved_clause_id string, ingested_at timestamp_ntz")
    put("cleaned", [], "doc_id string, ingested_at timestamp_ntz")
    put("sections", [], "doc_id string, section_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    months = [datetime(2024 + m // 12, m % 12 + 1, 1) for m in range(1, 14)]  # the last arrival is in February 2025
    want = Counter()
    for before in [*months, None]:
        seen = lambda at: before is None or at < before
        for key, at in refs:
            own = [r for r in rows if f"clause_{r[0]}" == key and seen(r[1])]
            why = "missing" if not own else "deleted" if all(r[2] for r in own) else "late" if min(r[1] for r in own) > at else None
            if why and seen(at):
                want[str(before - timedelta(microseconds=1)) if before else "end", f"{at:%Y-%m}", why] += 1
    got = problems.p5_snapshots(spark, str(tmp_path)).collect()
    assert {(r.as_of, r.period, r.reason): r.n for r in got} == want
    assert len({r.as_of for r in got}) == len(months) + 1
    assert problems.month_ends(None, None) == [] == problems.month_ends(T0, datetime(2024, 1, 31, 23))


def test_deletions_reopen_settled_references(spark, tmp_path):
    store = O.OrphanStore(spark, str(tmp_path), "last")
    for refs, pars, want in (
        ([reference(1, "a", 1)], [parent("a", 0)], []),
        ([], [parent("a", 2, True)], [(1, "deleted")]),
        ([], [parent("a", 3)], []),
        ([], [parent("a", 4, True)], [(1, "deleted")]),
    ):
        assert store.apply(*frames(spark, refs, pars))
        assert told(store.orphans()) == want
    with pytest.raises(ValueError):
        O.OrphanStore(spark, str(tmp_path), "any")


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    refs = [reference(k, f"k{k % 50}", 1, f"D{k % 40}") for k in range(2000)]
    pars = [parent(f"k{k % 50}", 0, doc=f"D{k % 40}") for k in range(0, 2000, 3)]
    store = O.OrphanStore(spark, str(tmp_path))
    store.apply(*frames(spark, refs, pars))
    whole = store.table("references").count() + store.table("parents").count()
    assert len(store.touched) > O.OWNERS
    before = {t: dict(f) for t, f in store.manifest["files"].items()}
    store.apply(*frames(spark, [reference(9000, "new", 2, "D7")], [parent("k7", 3, doc="D7")]))
    # the rows of one or two of the owner's buckets, not the state's
    read = store.table("references", store.touched).count() + store.table("parents", store.touched).count()
    assert len(store.touched) <= 2 and 0 < read < whole / 8
    changed = {b for t, f in store.manifest["files"].items() for b, p in f.items() if before[t].get(b) != p}
    assert changed <= set(map(str, store.touched))
    plain, _ = O.replay(*frames(spark, [*refs, reference(9000, "new", 2, "D7")], [*pars, parent("k7", 3, doc="D7")]), [])
    assert told(store.orphans()) == told(plain.orphans())


def test_hot_key(spark):
    refs = [reference(k, "hot" if k % 3 else "cold", 1) for k in range(900)]
    state, _ = O.replay(*frames(spark, refs, [parent("cold", 0)]), [])
    assert state.orphans().count() == 600


def test_orphan_stream_goes_on_after_a_restart(spark, tmp_path):
    cols = f"side string, {REF}, deleted boolean"
    first = spark.createDataFrame([("reference", *reference(1, "a", 1), None), ("reference", *reference(2, "b", 1), None)], cols)
    first.write.parquet(str(tmp_path / "in"))

    def run():
        s = ingest.OrphanStream(spark, str(tmp_path / "state"))
        s.start(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
        return s

    assert told(run().orphans()) == [(1, "missing"), (2, "missing")]
    parents = spark.createDataFrame([("parent", None, None, None, None, "clause", "D", "a", T0, False)], cols)
    parents.write.mode("append").parquet(str(tmp_path / "in"))
    s = run()
    assert told(s.orphans()) == [(2, "missing")]
    # a batch delivered again changes nothing
    assert not s.apply(spark.createDataFrame([("reference", *reference(3, "z", 1), None)], cols), 1) and told(s.orphans()) == [(2, "missing")]


def test_queries_match_their_sql(spark, data):
    import glob
    import os

    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    sql, queries = entry.oracle_sql(), entry.queries()
    assert set(sql) <= set(queries)
    for name in ("clean_text", "headings", "sections", "clause_roles", "references", "entities_merged", "chunks", "graph_edges", "unresolved_refs", "exported_labels", "p4_found", "p4_paths", "p5_found", "p5_snapshots", "findings", "import_diff", "merged_clauses", "search_titles"):
        df = queries[name](spark, data)
        r = c.execute(sql[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        got, want = df.collect(), r.fetchall()
        assert sorted(repr(tuple(x)) for x in got) == sorted(repr(tuple(y[names.index(k)] for k in df.columns)) for y in want), name
        assert want, name


def test_problem_queries_are_registered():
    assert {"p4_found", "p5_found"} <= set(problems.queries())
