"""Searches of the product's specification: nearest vectors and bounded traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows takes, and the tile of queries and rows whose scores are held at once.
BLOCK, TILE = 20_000, (512, 2048)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, least: float | None = None, version: str | None = None) -> DataFrame:
    """query_id, key, score, rank (from 1) of the k rows nearest to each query by cosine, the query's own row left out;
    ties by key. With `least`, lower scores are dropped; with `version`, a column, only rows of the query's value count
    (null is like no other). Exact: every row meets every query, a block of queries being broadcast at a time; each tile
    keeps the k best of each query, and those are ranked. Null vectors, and those of length zero, are in no pair. All
    vectors must have the queries' dimension."""
    extra = [version] if version else []
    given = queries.where(F.col(vector).isNotNull()).select(key, vector, *extra)
    total = given.count()
    kind = rows.schema[key].dataType.simpleString()
    out: DataFrame | None = None
    blocks = max(1, -(-total // BLOCK))
    for b in range(blocks):
        own = given.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        if own.empty:
            continue
        ids, matrix = own[key].to_numpy(), np.stack(own[vector].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(matrix, axis=1)
        kinds = own[version].astype(object).to_numpy() if version else np.zeros(len(ids), object)
        good = (norm > 0) & np.array([x is not None and x == x for x in kinds])
        shared = rows.sparkSession.sparkContext.broadcast((ids[good], matrix[good] / norm[good, None], kinds[good]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, q_kinds = shared.value
            for batch in batches:
                if not batch.num_rows or not len(q_ids):
                    continue
                for begin in range(0, batch.num_rows, TILE[1]):
                    part = batch.slice(begin, TILE[1])
                    r_ids = part.column(0).to_numpy(zero_copy_only=False)
                    r = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    r_kinds = np.array(part.column(2).to_pylist(), object) if version else np.zeros(len(r_ids), object)
                    size = np.linalg.norm(r, axis=1)
                    r_ids, r, r_kinds = r_ids[size > 0], r[size > 0] / size[size > 0, None], r_kinds[size > 0]
                    if not len(r_ids):
                        continue
                    for at in range(0, len(q_ids), TILE[0]):
                        tile = slice(at, at + TILE[0])
                        score = q[tile] @ r.T
                        score[(q_ids[tile, None] == r_ids[None, :]) | (q_kinds[tile, None] != r_kinds[None, :])] = -np.inf
                        if least is not None:
                            score[score < least] = -np.inf
                        # ties beyond the k-th stay, so that ranking by key can settle them
                        n = min(k, score.shape[1])
                        edge = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
                        at_q, at_r = np.nonzero((score >= edge[:, None]) & np.isfinite(score))
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[tile][at_q]), pa.array(r_ids[at_r]), pa.array(score[at_q, at_r])], names=["query_id", key, "score"])

        found = rows.where(F.col(vector).isNotNull()).select(key, vector, *extra).mapInArrow(run, f"query_id {kind}, `{key}` {kind}, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, `{key}` {kind}, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round("score", 5))


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """doc_id, start, node, hops: the nodes that each start (doc_id, start) reaches over edges (doc_id, source, target) in
    at most `hops` steps, with the fewest steps; the start itself only if it is reached again. Ends are matched within
    the document."""
    step = edges.select("doc_id", F.col("source").alias("node"), F.col("target").alias("next"))
    now = starts.select("doc_id", "start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    every = None
    for k in range(1, hops + 1):
        now = now.join(step, ["doc_id", "node"]).select("doc_id", "start", F.col("next").alias("node"), F.lit(k).alias("hops")).distinct()
        every = now if every is None else every.unionByName(now)
    return every.groupBy("doc_id", "start", "node").agg(F.min("hops").alias("hops"))
