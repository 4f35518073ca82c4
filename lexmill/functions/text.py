"""Text expressions that mean what the same names mean in Python, beyond ASCII too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\x01", "\x02"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+\z", "")


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by `order`; rows of equal order are told apart by their content. Rows with a null key
    count as rows of that key."""
    rest = [c for c in df.columns if c not in keys and c != order]
    plain = [c for c in rest if not df.schema[c].dataType.typeName() == "map"]
    tie = F.xxhash64(*[F.col(c) for c in plain]) if plain else F.lit(0)
    packed = F.max_by(F.struct(order, *rest), F.struct(F.col(order), tie))
    return df.groupBy(*keys).agg(packed.alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in df.columns if c not in keys])


def running(numbers: Column, size: int = 512) -> Column:
    """The sum of the elements before each, of an array of integers. It is built in stretches of `size`, as an array grown
    by one element at a time takes time in proportion to its square."""

    def folded(xs: Column, start: Column) -> Column:
        begin = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, begin, lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int")), lambda k: F.slice(numbers, k * size + 1, size))
    bases = folded(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: (acc + x).cast("int"))), F.lit(0))
    long = F.flatten(F.zip_with(parts, bases, folded))
    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).when(F.size(numbers) <= size, folded(numbers, F.lit(0))).otherwise(long)


def find_spans(df: DataFrame, keys: list[str], text: str, patterns: list[str]) -> DataFrame:
    """Every match of every pattern in the text: keys, pattern_no, span_start, span_end (code points), span_text.

    All patterns are tried in one pass over the rows, and each match gets its place there, so nothing is shuffled. Offsets
    are sums of lengths of the parts between matches, as Spark's own regex positions count UTF-16 units. Null texts give
    no row; keys need not be unique."""
    clean = F.translate(F.col(text), OPEN + CLOSE, "\x03\x03")
    tried = F.array(*[F.struct(F.lit(k).alias("pattern_no"), F.split(F.regexp_replace(clean, p, f"{OPEN}$0{CLOSE}"), OPEN, -1).alias("parts")) for k, p in enumerate(patterns)])

    def placed(x: Column) -> Column:
        # a part but for the first is a match, its end mark and what follows it
        starts = running(F.transform(x["parts"], lambda part, k: F.length(part) - (k > 0).cast("int")))
        found = F.zip_with(x["parts"], starts, lambda part, at: F.struct(x["pattern_no"].alias("pattern_no"), at.alias("a"), F.substring_index(part, CLOSE, 1).alias("b")))
        return F.slice(found, 2, 1 << 30)

    hits = F.flatten(F.transform(F.filter(tried, lambda x: F.size(x["parts"]) > 1), placed))
    found = df.where(F.col(text).isNotNull()).select(*keys, F.explode(hits).alias("x"))
    return found.select(*keys, "x.pattern_no", F.col("x.a").alias("span_start"), (F.col("x.a") + F.length("x.b")).alias("span_end"), F.col("x.b").alias("span_text"))
