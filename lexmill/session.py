"""Session helpers: table access, shared working tables and spreading of small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("LEXMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lexmill-"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named parquet table; with columns, only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A local session without one gets a temporary
    folder; on a cluster a machine-local folder would lose rows, so a missing setting is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def files_of(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that runs meanwhile go as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """Written tables of one query in the shared folder. write() cuts lineage: what follows reads files that outlive
    any executor. drop() removes a table that nothing will read again, clear() all of them; the rest goes when the driver
    ends. If tidy, the shuffle files of a write() go with its end, not when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def claim(self) -> str:
        """The folder, which will be deleted when the driver ends, not while something may read it."""
        where, files = files_of(self.spark, self.root)
        files.mkdirs(where)
        files.deleteOnExit(where)
        return self.root

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.count += 1
        if self.count == 1:
            self.claim()
        path = f"{self.root}/t{self.count}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with shuffles_removed(self.spark) if self.tidy else nullcontext():
            writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._lexmill_path = path
        return back

    def write_counted(self, df: DataFrame, counted: Column) -> tuple[DataFrame, int]:
        """write(), and for how many of the rows `counted` holds, told by the same job."""
        seen = Observation()
        back = self.write(df.observe(seen, F.count_if(counted).alias("n")))
        return back, seen.get["n"]

    def write_parted(self, df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame, int]:
        """The rows for which flag holds and the others, each in files of its own, and the number of the former."""
        seen = Observation()
        rows = df.withColumn("parted", F.coalesce(flag, F.lit(False)))
        path = self.write(rows.observe(seen, F.count_if("parted").alias("n")), "parted")._lexmill_path

        def part(value: str) -> DataFrame:
            where, files = files_of(self.spark, f"{path}/parted={value}")
            return self.spark.read.schema(df.schema).parquet(f"{path}/parted={value}") if files.exists(where) else self.spark.createDataFrame([], df.schema)

        return part("true"), part("false"), seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_lexmill_path", None)
        if path:
            where, files = files_of(self.spark, path)
            files.delete(where, True)

    def clear(self) -> None:
        where, files = files_of(self.spark, self.root)
        files.delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions df by keys when its scan has fewer partitions than the session has cores, as one small file
    does; larger inputs pass unchanged, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def broadcast_if_small(df: DataFrame, rows: int, bytes_a_row: int, limit: int = 32 << 20) -> DataFrame:
    """Marks df for broadcast when its counted rows stay under limit bytes; otherwise leaves the join to shuffle."""
    return F.broadcast(df) if rows * bytes_a_row <= limit else df


def fmt3(prefix: Column, letter: str, number: Column) -> Column:
    """prefix + letter + number padded to three digits, wider when the number is."""
    return F.concat(prefix, F.lit(letter), F.format_string("%03d", number))
