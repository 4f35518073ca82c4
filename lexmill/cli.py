"""Command line: `preview` writes the JSON of documents, `export` their graph into a database or as Cypher statements."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.operators import graph
from lexmill.plans import pipeline
from lexmill.session import files_of, local_session
from lexmill.sinks import graph_store
from lexmill.sources import documents


def parse(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("preview", "export"):
        s = sub.add_parser(name)
        s.add_argument("path", nargs="?")
        s.add_argument("--text")
        s.add_argument("--output", default="output")
    # a database to export to, in place of a folder of statements
    for name, default in (("uri", ""), ("user", "neo4j"), ("password", "")):
        s.add_argument(f"--{name}", default=os.environ.get(f"NEO4J_{name.upper()}", default))
    out = p.parse_args(argv)
    if (out.path is None) == (out.text is None):
        p.error("give a path or --text")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, connect: graph_store.Connect | None = None) -> int:
    """0 when done, 1 when a document failed; wrong arguments exit with 2."""
    args = parse(argv)
    spark = spark or local_session()
    if args.path is not None:
        where, files = files_of(spark, args.path)
        if not files.globStatus(where):
            print(f"File not found: {args.path}", file=sys.stderr)
            return 1
    loaded = documents.inline(spark, [("text.txt", args.text)]) if args.text is not None else documents.scan(spark, args.path)
    failed = 0
    for r in loaded.where("error_kind is not null").select("filename", "error_msg").toLocalIterator():
        failed += 1
        print(f"{r.filename}: {r.error_msg}", file=sys.stderr)
    out = pipeline.run(loaded.where("error_kind is null"))
    if args.command == "preview":
        pipeline.write_previews(pipeline.preview(out), args.output)
    else:
        nodes, edges = pipeline.knowledge_graph(loaded.select("doc_id", "title"), out.clauses, out.references)
        if args.uri:
            told = graph_store.export(nodes, edges, connect or graph_store.bolt(args.uri, args.user, args.password))
            for r in told.where("error is not null").select("doc_id", "error").toLocalIterator():
                failed += 1
                print(f"{r.doc_id}: {r.error}", file=sys.stderr)
            made = told.agg(F.sum("nodes_created").alias("n"), F.sum("relationships_created").alias("r")).first()
            print(f"{made.n or 0} nodes, {made.r or 0} relationships created", file=sys.stderr)
        else:
            graph.cypher(*graph.exported(nodes, edges), indexed=False).drop("error").write.mode("overwrite").json(args.output)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
