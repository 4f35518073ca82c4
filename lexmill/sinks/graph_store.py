"""Graphs into a graph database, by a connection that the caller gives; and the way from documents or graphs to it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import enrich, graph
from lexmill.session import Workspace

#: Makes a driver with session() -> context manager of run() and execute_write(), and close(), in a worker.
Connect = Callable[[], object]
LOADED = "nodes_created int, relationships_created int, execution_ms double, error string"
#: Rules in the order in which a graph is checked; the first broken one is told.
RULES = ["empty_graph", "unknown_label", "empty_properties", "duplicate_id", "unknown_type", "dangling_source", "dangling_target", "self_loop"]


def bolt(uri: str, user: str, password: str) -> Connect:
    """Connects by the database's own library, which need not be installed here."""

    def connect() -> object:
        from neo4j import GraphDatabase

        driver = GraphDatabase.driver(uri, auth=(user, password))
        driver.verify_connectivity()
        return driver

    return connect


def run_document(driver: object, statements: list[tuple[str, dict]], database: str | None) -> tuple[int, int]:
    """All statements explained, then run in one write transaction, which a failure rolls back; what it created."""
    with driver.session(database=database) if database else driver.session() as session:
        # one text stands for all statements that differ in parameters only
        for query, parameters in {q: p for q, p in reversed(statements)}.items():
            try:
                session.run(f"EXPLAIN {query}", parameters).consume()
            except Exception as e:
                raise RuntimeError(f"EXPLAIN failed for '{query}': {e}") from e

        def work(tx) -> tuple[int, int]:
            made = [tx.run(q, p).consume().counters for q, p in statements]
            return sum(c.nodes_created for c in made), sum(c.relationships_created for c in made)

        return session.execute_write(work)


def load(statements: DataFrame, connect: Connect, database: str | None = None) -> DataFrame:
    """doc_id and LOADED of each document with statements (as graph.cypher gives them): its graph goes in by one
    transaction, nodes before edges, and comes back with its counts or, rolled back, with its error. A partition opens one
    connection. A document's statements are held by the worker that runs them, as the transaction holds them too. Reading
    the result runs the load, so it is written at once and comes from the written rows."""
    kind = statements.schema["doc_id"].dataType.simpleString()
    placed = statements.repartition("doc_id").sortWithinPartitions("doc_id", "part", "no")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        driver, broken = None, None

        def finish(doc: object, own: list) -> pd.DataFrame:
            nonlocal driver, broken
            began, made, error = time.perf_counter(), (0, 0), next((e for _, _, e in own if e), None)
            if error is None:
                try:
                    if driver is None and broken is None:
                        try:
                            driver = connect()
                        except Exception as e:
                            broken = f"Failed to connect: {e}"
                    if broken:
                        raise RuntimeError(broken)
                    made = run_document(driver, [(q, json.loads(p)) for q, p, _ in own], database)
                except Exception as e:
                    error = str(e)
            return pd.DataFrame([(doc, *made, (time.perf_counter() - began) * 1000, error)], columns=["doc_id", "nodes_created", "relationships_created", "execution_ms", "error"])

        try:
            doc, own = None, []
            for part in parts:
                for r in part.itertuples(index=False):
                    if own and r.doc_id != doc:
                        yield finish(doc, own)
                        own = []
                    doc = r.doc_id
                    own.append((r.query, r.parameters, r.error))
            if own:
                yield finish(doc, own)
        finally:
            if driver is not None:
                driver.close()

    found = placed.select("doc_id", "part", "no", "query", "parameters", "error").mapInPandas(run, f"doc_id {kind}, {LOADED}")
    return Workspace(statements.sparkSession, "load").write(found)


def export(nodes: DataFrame, edges: DataFrame, connect: Connect, labels: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """The graph under its export names into the database, unchecked; documents without nodes have no row."""
    known = nodes.select("doc_id").distinct()
    return load(graph.cypher(*graph.exported(nodes, edges.join(known, "doc_id", "left_semi"), labels, types), indexed=False), connect)


def checked(nodes: DataFrame, edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, error of each document whose graph breaks a rule: the first in RULES, and what breaks it."""
    found = graph.violations(nodes, edges, documents)
    rank = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    return found.groupBy("doc_id").agg(F.min(F.struct(rank.alias("k"), F.concat_ws(" ", "rule", F.nullif("subject", F.lit(""))).alias("error"))).alias("x")).select("doc_id", "x.error")


def build_from_graphs(nodes: DataFrame, edges: DataFrame, documents: DataFrame, connect: Connect | None = None) -> DataFrame:
    """doc_id, nodes_in_ir, relationships_in_ir, LOADED, one row for each of documents (doc_id): graphs are checked, turned
    into statements and, with a connection, loaded. A graph that breaks a rule isn't loaded and has the rule as its error;
    so has one with a label or type that is no identifier."""
    work = Workspace(nodes.sparkSession, "build")
    nodes, edges = work.write(nodes), work.write(edges)
    bad = work.write(checked(nodes, edges, documents))
    good = lambda df: df.join(bad, "doc_id", "left_anti")
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count("*").cast("int").alias(name))
    out = documents.select("doc_id").distinct().join(counted(nodes, "nodes_in_ir"), "doc_id", "left").join(counted(edges, "relationships_in_ir"), "doc_id", "left").join(bad.withColumnRenamed("error", "broken"), "doc_id", "left")
    if connect is None:
        out = out.select("*", F.lit(None).cast("int").alias("nodes_created"), F.lit(None).cast("int").alias("relationships_created"), F.lit(None).cast("double").alias("execution_ms"), F.lit(None).cast("string").alias("error"))
    else:
        out = out.join(load(graph.cypher(good(nodes), good(edges)), connect), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", zero("nodes_in_ir"), zero("relationships_in_ir"), zero("nodes_created"), zero("relationships_created"), "execution_ms", F.coalesce("broken", "error").alias("error"))


def build(prompts: DataFrame, model: enrich.Model, connect: Connect | None = None) -> DataFrame:
    """build_from_graphs of the graphs that a model makes of prompts (doc_id, system, user). The model is asked once a
    document; an answer that can't be read is the document's error."""
    answers = Workspace(prompts.sparkSession, "answers").write(enrich.ask(prompts.select("doc_id", "system", "user"), "system", "user", model).select("doc_id", "answer"))
    nodes, edges, failed = enrich.read_graphs(answers)
    made = build_from_graphs(nodes, edges, answers.join(failed, "doc_id", "left_anti"), connect)
    lost = failed.select("doc_id", *[F.lit(0).alias(c) for c in ("nodes_in_ir", "relationships_in_ir", "nodes_created", "relationships_created")], F.lit(None).cast("double").alias("execution_ms"), "error")
    return made.unionByName(lost)
