"""Problem 5: references to records that don't exist, kept up to date as rows arrive.

Method: keyed pending-orphan state. The state is an index of parents and the references that wait for one, in buckets by
a hash of the parent's key. A batch of new references probes the index; arriving parents resolve references that wait;
deletions reopen references that had settled. Only the buckets of a batch's keys are read and written anew, and a
manifest names the files of each bucket, so the state outlives the process that keeps it. Both sides are joined on the
parent's key, so a key that many references share is a matter for the join's skew handling, never a collected group.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Workspace, files_of

PARENT = ["kind", "owner", "key"]
REFERENCE = ["table_name", "field_name", "doc_id", "ord", *PARENT]
KEY = "kind string, owner string, key string"
TABLES = {
    "parents": f"{KEY}, first_at timestamp_ntz, live boolean, last_at timestamp_ntz, last_live boolean",
    "references": f"table_name string, field_name string, doc_id string, ord int, {KEY}, at timestamp_ntz, reason string",
}
#: Buckets by owner, and buckets of one owner by key: batches of few owners touch few buckets, and no owner is one bucket.
OWNERS, KEYS = 8, 4


def bucket() -> Column:
    return (F.pmod(F.xxhash64("owner"), F.lit(OWNERS)) * KEYS + F.pmod(F.xxhash64("kind", "key"), F.lit(KEYS))).cast("int")


def exists(rule: str) -> Column:
    """Whether a parent counts as there: `any`, while one of its rows is live; `last`, while its last row is."""
    return F.col("live") if rule == "any" else F.col("last_live")


def reason(rule: str) -> Column:
    return F.when(F.col("first_at").isNull(), "missing").when(~exists(rule), "deleted").when(F.col("first_at") > F.col("at"), "late")


def index_of(parents: DataFrame) -> DataFrame:
    """The index entries of parent rows (kind, owner, key, at, deleted), aggregated before they are shuffled."""
    last = F.max(F.struct("at", (~F.col("deleted")).alias("live")))
    return parents.groupBy(*PARENT).agg(F.min("at").alias("first_at"), F.max(~F.col("deleted")).alias("live"), last.alias("last")).select(*PARENT, "first_at", "live", F.col("last.at").alias("last_at"), F.col("last.live").alias("last_live"))


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new)
    merged = both.groupBy(*PARENT).agg(F.min("first_at").alias("first_at"), F.max("live").alias("live"), F.max(F.struct("last_at", "last_live")).alias("last"))
    return merged.select(*PARENT, "first_at", "live", "last.last_at", "last.last_live")


class OrphanStore:
    """The state in a folder that all executors share. Opened again, it goes on from its last batch."""

    def __init__(self, spark: SparkSession, root: str, rule: str = "any", tidy: bool = True):
        """tidy: files that the last batch made obsolete are deleted, so readers of an earlier state must have finished."""
        self.spark, self.root, self.rule, self.tidy = spark, root.rstrip("/"), rule, tidy
        where, files = files_of(spark, f"{self.root}/manifests")
        names = sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []
        names = [n for n in names if n.endswith(".json")]
        self.manifest = self.load(names[-1]) if names else {"batch": -1, "rule": rule, "files": {t: {} for t in TABLES}}
        if self.manifest["rule"] != rule:
            raise ValueError(f"the state was kept under the rule {self.manifest['rule']}")
        #: Buckets that the last batch read and wrote.
        self.touched: list[int] = []

    def load(self, name: str) -> dict:
        where, files = files_of(self.spark, f"{self.root}/manifests/{name}")
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Writes the manifest under another name first, so that a half-written one is never read."""
        name = f"{self.root}/manifests/{manifest['batch']:012d}"
        where, files = files_of(self.spark, f"{name}.part")
        stream = files.create(where, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        files.rename(where, files_of(self.spark, f"{name}.json")[0])
        self.manifest = manifest

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        paths = [p for b, p in self.manifest["files"][name].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def put(self, name: str, df: DataFrame, buckets: list[int], batch: int, manifest: dict) -> None:
        """Writes the buckets' rows and enters them into the manifest; buckets left without rows lose their entry."""
        folder = f"{self.root}/{name}/{batch:012d}"
        df.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
        where, files = files_of(self.spark, folder)
        found = {f.getPath().getName().partition("=")[2] for f in files.listStatus(where) if f.isDirectory()}
        own = manifest["files"][name]
        for b in map(str, buckets):
            own.pop(b, None)
            if b in found:
                own[b] = f"{folder}/bucket={b}"

    def apply(self, references: DataFrame, parents: DataFrame, batch: int | None = None) -> bool:
        """Takes a batch of references (REFERENCE, at) and parent rows (PARENT, at, deleted); False if a batch of that
        number or a later one has been taken.

        A reference waits while its parent is missing, deleted or came after it (`late` ones wait for good, unless an
        earlier row of the parent is delivered). Under the rule `any`, a live row can't be taken back, so settled
        references are dropped; under `last`, they are kept and wait again when the last row of their parent is a deletion.
        Repeated references keep their earliest time; null keys must have been filtered out; null owners never match."""
        batch = self.manifest["batch"] + 1 if batch is None else batch
        if batch <= self.manifest["batch"]:
            return False
        work = Workspace(self.spark, "orphan-batch")
        fresh = work.write(index_of(parents).withColumn("bucket", bucket()))
        new = work.write(references.groupBy(*REFERENCE).agg(F.min("at").alias("at")).withColumn("bucket", bucket()))
        met = fresh.select("bucket", F.lit(True).alias("fresh")).unionAll(new.select("bucket", F.lit(False))).distinct().collect()
        renewed, self.touched = sorted(r.bucket for r in met if r.fresh), sorted({r.bucket for r in met})
        manifest = json.loads(json.dumps(self.manifest)) | {"batch": batch}
        if renewed:
            self.put("parents", merge_index(self.table("parents", renewed), fresh.drop("bucket")), renewed, batch, manifest)
        if self.touched:
            held = self.table("references", self.touched)
            self.manifest, before = manifest, self.manifest
            index = self.table("parents", self.touched)
            self.manifest = before
            open_ones = held.drop("reason").unionByName(new.drop("bucket")).groupBy(*REFERENCE).agg(F.min("at").alias("at"))
            told = open_ones.join(index, PARENT, "left").withColumn("reason", reason(self.rule)).select(*REFERENCE, "at", "reason")
            self.put("references", told if self.rule == "last" else told.where("reason is not null"), self.touched, batch, manifest)
        self.commit(manifest)
        work.clear()
        if self.tidy:
            self.sweep()
        return True

    def sweep(self) -> None:
        """Deletes batches' folders of which no bucket is in the manifest, and all manifests but the last two."""
        for name, own in self.manifest["files"].items():
            used = {p.rpartition("/")[0].rpartition("/")[2] for p in own.values()}
            where, files = files_of(self.spark, f"{self.root}/{name}")
            for f in files.listStatus(where) if files.exists(where) else ():
                if f.getPath().getName() not in used:
                    files.delete(f.getPath(), True)
        where, files = files_of(self.spark, f"{self.root}/manifests")
        for f in sorted(files.listStatus(where), key=lambda f: f.getPath().getName())[:-2]:
            files.delete(f.getPath(), True)

    def orphans(self) -> DataFrame:
        """The references that wait, each with its reason and the month of its earliest arrival."""
        return self.table("references").where("reason is not null").select("table_name", "field_name", F.date_format("at", "yyyy-MM").alias("period"), "doc_id", "ord", "reason")

    def snapshot(self, as_of: Column) -> DataFrame:
        """Counts of waiting references per table, field, period and reason."""
        return self.orphans().groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n")).withColumn("as_of", as_of)


def replay(references: DataFrame, parents: DataFrame, cuts: list[datetime], rule: str = "any") -> tuple[OrphanStore, list[DataFrame]]:
    """Applies the rows in slices of arrival time, cut at `cuts`; the state after the last, and a snapshot after each."""
    spark = references.sparkSession
    store, shots = OrphanStore(spark, Workspace(spark, "orphans").claim(), rule, tidy=False), []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        within = F.lit(True)
        if low is not None:
            within &= F.col("at") > F.lit(low)
        if high is not None:
            within &= F.col("at") <= F.lit(high)
        # rows without a time come with the first slice
        within = F.coalesce(within, F.lit(low is None))
        store.apply(references.where(within), parents.where(within))
        shots.append(store.snapshot(F.lit(str(high) if high is not None else "end")))
    return store, shots


def snapshots(references: DataFrame, parents: DataFrame, cuts: list[datetime]) -> DataFrame:
    """The snapshots of replay(references, parents, cuts) under the rule `any`, without the states in between.

    A reference's reason at a time follows from its own arrival, its parent's first row and its parent's first live row.
    So each has a stretch of slices as missing, as deleted and as late; starts and ends of stretches are counted and
    summed up over the slices, and no reference is repeated for each slice it waits."""
    end, start = len(cuts), F.lit("0001-01-01").cast("timestamp_ntz")
    limits = F.array(*[F.lit(str(c)).cast("timestamp_ntz") for c in cuts]) if cuts else F.array().cast("array<timestamp_ntz>")
    # the slice in which a time falls; rows without a time come with the first slice
    slice_of = lambda at: F.size(F.filter(limits, lambda c: c < at))
    index = parents.groupBy(*PARENT).agg(F.min("at").alias("first_at"), F.min(F.when(~F.col("deleted"), F.coalesce("at", start))).alias("live_at"))
    told = references.groupBy(*REFERENCE).agg(F.min("at").alias("at")).join(index, PARENT, "left")
    never = F.lit(end + 1)
    slot = lambda c: F.when(F.col(c).isNull(), never).otherwise(slice_of(F.col(c)))
    told = told.withColumn("came", slice_of(F.coalesce("at", start))).withColumn("known", slot("first_at")).withColumn("live", slot("live_at"))
    there = F.greatest("came", "known")
    stretches = [("missing", F.col("came"), F.col("known")), ("deleted", there, F.col("live")), ("late", F.greatest(there, F.col("live")), F.when(F.col("first_at") > F.col("at"), never).otherwise(0))]
    told = told.select("table_name", "field_name", F.date_format("at", "yyyy-MM").alias("period"), F.explode(F.array(*[F.struct(F.lit(why).alias("reason"), low.alias("low"), high.alias("high")) for why, low, high in stretches])).alias("x")).where("x.low < x.high")
    group = ["table_name", "field_name", "period", "reason"]
    steps = told.select(*group[:3], "x.reason", F.explode(F.array(F.struct(F.col("x.low").alias("slot"), F.lit(1).alias("n")), F.struct(F.col("x.high").alias("slot"), F.lit(-1).alias("n")))).alias("y"))
    steps = steps.groupBy(*group, F.col("y.slot").alias("slot")).agg(F.sum("y.n").alias("n"))
    ordered = Window.partitionBy(*group).orderBy("slot")
    levels = steps.select(*group, "slot", F.sum("n").over(ordered).alias("n"), F.lead("slot").over(ordered).alias("next")).where("n > 0")
    label = F.element_at(F.array(*[F.lit(str(c)) for c in cuts], F.lit("end")), F.col("at") + 1)
    return levels.select(*group, "n", F.explode(F.sequence(F.col("slot"), F.col("next") - 1)).alias("at")).select(*group, "n", label.alias("as_of"))
