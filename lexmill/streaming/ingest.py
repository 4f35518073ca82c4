"""Streaming twins: new files to chunks, and references and parents to orphan state, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import orphans as O
from lexmill.plans import pipeline
from lexmill.sources import documents


def files_to_chunks(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the pipeline over files as they arrive in the folder; each batch's chunks go to sink(chunks, batch)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def batch(df: DataFrame, k: int) -> None:
        sink(pipeline.run(documents.load(df.select("path", "content"))).chunks, k)

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OrphanStream:
    """Keeps the orphan state over batches of one stream of rows (side: `reference` or `parent`, the columns of both). The
    state lies in `root`, a folder that all executors share, by batch number: opened again it goes on where it was, and a
    batch that the stream delivers again after a failure isn't taken twice."""

    def __init__(self, spark: SparkSession, root: str, rule: str = "any"):
        self.store = O.OrphanStore(spark, root, rule)

    def apply(self, batch: DataFrame, k: int) -> bool:
        references = batch.where("side = 'reference'").select(*O.REFERENCE, "at")
        parents = batch.where("side = 'parent'").select(*O.PARENT, "at", "deleted")
        return self.store.apply(references, parents, k)

    def orphans(self) -> DataFrame:
        return self.store.orphans()

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(lambda df, k: self.apply(df, k) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window of event time and group, late rows dropped beyond the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "n")
