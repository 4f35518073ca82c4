"""Values from the rows before or after a row in a long ordered group, without one task for the whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of an integer order that one bucket holds.
PLACES = 4096


def bucket_of(order: str, places: int = PLACES) -> Column:
    return F.floor(F.col(order) / places)


def across(df: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, leads: dict[str, Column] | None = None) -> DataFrame:
    """df with more columns: of the group `keys` in its `order`, `sums` add up the rows before a row (0 for the first),
    `lasts` hold the last value before it that isn't null, `leads` the value of the next row.

    A group is cut into buckets, numbers that must not fall where the order rises (null before all others). A bucket's
    rows are ordered in one task; what lies in other buckets comes from one row a bucket, joined back. Null keys are a
    group like any other. df is read twice: where it is dear, write it first."""
    sums, lasts, leads = sums or {}, lasts or {}, leads or {}
    given = df.withColumn("_g", F.struct(*keys)).withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-(1 << 62))))
    place = F.struct(*order)
    own = [(f"_s{k}", c) for k, c in enumerate(sums.values())] + [(f"_l{k}", c) for k, c in enumerate(lasts.values())] + [(f"_n{k}", F.struct(c.alias("v"))) for k, c in enumerate(leads.values())]
    given = given.select("*", *[c.alias(n) for n, c in own])
    total = [F.sum(f"_s{k}").alias(f"_cs{k}") for k in range(len(sums))]
    final = [F.max_by(f"_l{k}", F.when(F.col(f"_l{k}").isNotNull(), place)).alias(f"_cl{k}") for k in range(len(lasts))]
    first = [F.min_by(f"_n{k}", place).alias(f"_cn{k}") for k in range(len(leads))]
    told = given.groupBy("_g", "_b").agg(*total, *final, *first)
    upper = Window.partitionBy("_g").orderBy("_b")
    past = upper.rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(
        "_g",
        "_b",
        *[F.coalesce(F.sum(f"_cs{k}").over(past), F.lit(0)).alias(f"_cs{k}") for k in range(len(sums))],
        *[F.last(f"_cl{k}", ignorenulls=True).over(past).alias(f"_cl{k}") for k in range(len(lasts))],
        *[F.lead(f"_cn{k}").over(upper).alias(f"_cn{k}") for k in range(len(leads))],
    )
    w = Window.partitionBy("_g", "_b").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    near = given.select(
        *df.columns,
        "_g",
        "_b",
        *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in range(len(sums))],
        *[F.last(f"_l{k}", ignorenulls=True).over(before).alias(f"_l{k}") for k in range(len(lasts))],
        *[F.lead(f"_n{k}").over(w).alias(f"_n{k}") for k in range(len(leads))],
    )
    return near.join(told, ["_g", "_b"]).select(
        *df.columns,
        *[(F.col(f"_s{k}") + F.col(f"_cs{k}")).alias(n) for k, n in enumerate(sums)],
        *[F.coalesce(f"_l{k}", f"_cl{k}").alias(n) for k, n in enumerate(lasts)],
        *[F.coalesce(f"_n{k}", f"_cn{k}")["v"].alias(n) for k, n in enumerate(leads)],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """df with the place of each row in its group, from 0."""
    return across(df, keys, order, bucket, sums={name: F.lit(1)})
