"""Problem 2: cutting oversized texts at natural boundaries.

Method: byte-range processing. A text becomes ranges in one pass, or a file is read by byte ranges; what is shuffled, and
what a worker splits, is a range with a halo before it and a short look ahead, so that two neighbours find the same cut at
the border they share. Inside a range the pieces are packed one after another; counts of pieces (and, for files, of
characters) become positions by prefix sums over the ranges. Only the worker that reads a table's row sees a whole text;
of a file, none does.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Workspace
from lexmill.sources.stores import read_range

LIMIT, OVERLAP, CHARS = 512, 64, 4
RANGE = 32_768
#: Characters beyond a border that are looked at for its cut, which is sought in a whole piece before the border.
AHEAD = 64
#: Characters of ranges in one Arrow batch.
BATCH = 8 << 20

PARAGRAPH = re.compile(r"\S(?=[^\S\n]*\n[^\S\n]*\n)")
SENTENCE = re.compile(r"[.!?;…][)\]\"'”’»]*(?=\s)|[。！？]|\S(?=[^\S\n]*\n)")
WORD = re.compile(r"\S(?=\s)")
START = re.compile(r"(?<=\s)\S")


def token_estimate(text):
    """Estimated tokens of a text column: a quarter of its characters, at least one; null for null."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS)).cast("int")


def settle(text: str, at: int) -> int:
    """A position at or before `at` (though not 0) that splits no character from its combining marks."""
    k = at
    while 1 < k < len(text) and (unicodedata.category(text[k])[0] == "M" or text[k] == "\u200d" or text[k - 1] == "\u200d"):
        k -= 1
    return k if k > 1 else at


def border_cut(text: str, border: int, most: int) -> int:
    """The cut for a border between ranges: the last paragraph or sentence end in the half piece before it, or the last
    word end in the whole piece. It looks at the same characters whichever of the two ranges asks."""
    begin = max(0, border - most)
    window = text[begin : border + AHEAD]
    for pattern, least in ((PARAGRAPH, most // 2), (SENTENCE, most // 2), (WORD, 0)):
        ends = [m.end() for m in pattern.finditer(window) if least < m.end() <= border - begin]
        if ends:
            return begin + ends[-1]
    return begin + settle(window, border - begin)


def overlap_start(text: str, cut: int, least: int, overlap: int) -> int:
    """Where the piece after `cut` begins: at the first word start of the last `overlap` characters, after `least`."""
    begin = max(least + 1, cut - overlap)
    m = START.search(text, max(begin, 1), cut)
    return m.start() if m and m.start() < cut else min(settle(text, begin) if settle(text, begin) > least else begin, cut - 1)


def cut_range(text: str, begin: int, stop: int, first: bool, last: bool, most: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [from, to) of the range [begin, stop) of `text`, which holds the halo before and the look ahead after it."""
    cut = 0 if first else border_cut(text, begin, most)
    end = len(text) if last else border_cut(text, stop, most)
    if cut >= end:
        return []
    ends = [[m.end() for m in p.finditer(text)] for p in (PARAGRAPH, SENTENCE, WORD)]
    start = 0 if first else overlap_start(text, cut, -1, overlap)
    out = []
    while end - start > most:
        # the rest after this piece stays longer than an overlap, so that no piece starts before the one before it
        high = min(start + most, end - overlap - 1)
        low = max(cut, start + most // 2)
        at = 0
        for k, own in enumerate(ends):
            j = bisect_right(own, high) - 1
            if j >= 0 and own[j] > (cut if k == 2 else low):
                at = own[j]
                break
        if not at:
            at = settle(text, high)
            at = at if at > cut else high
        out.append((start, at))
        start, cut = overlap_start(text, at, start, overlap), at
    out.append((start, end))
    return out


def piece_rows(ranges: DataFrame, most: int, overlap: int) -> DataFrame:
    """From ranges (item, range_no, base, begin, stop, first, last, chunk): pieces with their number in the range."""
    kind = ranges.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = {n: part.column(n).to_pylist() for n in ("base", "begin", "stop", "first", "last", "chunk")}
                rows, no, begins, ends, texts = [], [], [], [], []
                for k, chunk in enumerate(cols["chunk"]):
                    for j, (a, b) in enumerate(cut_range(chunk, cols["begin"][k], cols["stop"][k], cols["first"][k], cols["last"][k], most, overlap)):
                        rows.append(k)
                        no.append(j)
                        begins.append(cols["base"][k] + a)
                        ends.append(cols["base"][k] + b)
                        texts.append(chunk[a:b])
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(own), part.column("range_no").take(own), pa.array(no, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())],
                    names=["item", "range_no", "no", "piece_start", "piece_end", "piece_text"],
                )

    return ranges.mapInArrow(run, f"item {kind}, range_no bigint, no int, piece_start bigint, piece_end bigint, piece_text string")


def numbered(pieces: DataFrame, work: Workspace) -> DataFrame:
    """Adds piece_no, from 0 in each item: the prefix sum of the ranges' counts plus the number in the range. The pieces
    are written first, so that no text is split twice."""
    pieces = work.write(pieces)
    counts = pieces.groupBy("item", "range_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.join(counts.select("item", "range_no", before.alias("base")), ["item", "range_no"]).select("item", (F.col("base") + F.col("no")).alias("piece_no"), "piece_start", "piece_end", "piece_text")


def halo_of(most: int, overlap: int) -> int:
    """Characters before a range that its first cut and the overlap before that cut can ask for."""
    return most + overlap + 1


def text_ranges(df: DataFrame, most: int, overlap: int, size: int = RANGE) -> DataFrame:
    """Ranges of (item, text), as piece_rows takes them: one pass over each text, in proportion to its length."""
    halo = halo_of(most, overlap)
    if size <= halo + AHEAD:
        raise ValueError("size is too small for the halo")
    kinds = {"range_no": pa.int64(), "base": pa.int64(), "begin": pa.int32(), "stop": pa.int32(), "first": pa.bool_(), "last": pa.bool_(), "chunk": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: dict[str, list] = {k: [] for k in kinds}
            held = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["item", *kinds])  # noqa: B023

            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                for at in range(0, len(text), size):
                    base = max(0, at - halo)
                    rows.append(row)
                    for name, value in zip(kinds, (at // size, base, at - base, at - base + size, at == 0, at + size >= len(text), text[base : at + size + AHEAD])):
                        out[name].append(value)
                    held += size
                    if held >= BATCH:
                        yield flush()
                        rows, out, held = [], {k: [] for k in kinds}, 0
            if rows:
                yield flush()

    kind = df.schema["item"].dataType.simpleString()
    return df.select("item", "text").mapInArrow(run, f"item {kind}, range_no bigint, base bigint, begin int, stop int, first boolean, last boolean, chunk string")


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of every record whose text has more than `limit` estimated tokens: keys, piece_no, piece_start, piece_end
    (code points, end exclusive), piece_text, token_estimate. Each piece has at most `limit` estimated tokens and, but
    for the first, begins up to `overlap` estimated tokens (one character or more) before the end of the one before.

    Null and smaller texts give no row; records repeated with one text count once, and one key with several texts gives
    the pieces of each. Columns other than keys and text are ignored; their names may clash with anything."""
    most, back = limit * CHARS + CHARS - 1, max(1, overlap * CHARS)
    records = df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.col(text).alias("text"))
    large = records.where(token_estimate("text") > limit).select(F.struct("key", F.md5("text").alias("version")).alias("item"), "text")
    # one shuffle spreads the ranges, whatever text they are of, and takes repeated rows together
    ranges = text_ranges(large, most, back, size).dropDuplicates(["item", "range_no"])
    pieces = numbered(piece_rows(ranges, most, back), Workspace(df.sparkSession, "pieces"))
    return pieces.select(*[F.col(f"item.key.k{i}").alias(k) for i, k in enumerate(keys)], "piece_no", "piece_start", "piece_end", "piece_text", token_estimate("piece_text").alias("token_estimate"))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The same for UTF-8 files on a file system that every executor sees, local, HDFS or an object store (as far as
    pyarrow's file systems go): path, piece_no, piece_start, piece_end, piece_text. Workers read byte ranges; a first pass
    counts the characters of each range, whose prefix sums turn places in a range into places in the file. A file within
    the limit is one piece; an empty one gives none. A range must hold more bytes than its halo can have."""
    most, back = limit * CHARS + CHARS - 1, max(1, overlap * CHARS)
    halo = 4 * halo_of(most, back)
    if size <= halo + 4 * AHEAD:
        raise ValueError("size is too small for the halo")
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("length") - 1) / size).cast("long"))).alias("range_no"))
    parts = parts.repartition("path", "range_no")

    def skip(data: bytes, at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(b & 0xC0 != 0x80 for b in read_range(p, k * size, size)) for p, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["path", "length", "range_no", "chars"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("base", "begin", "stop", "first", "last", "chunk")}
            for path, length, k, chars_before in zip(*(batch.column(n).to_pylist() for n in ("path", "length", "range_no", "chars_before"))):
                at = max(0, k * size - halo)
                data = read_range(path, at, k * size - at + size + 4 * AHEAD + 4)
                a, b, c = skip(data, 0), skip(data, k * size - at), skip(data, k * size - at + size)
                head, body, tail = data[a:b].decode("utf-8"), data[b:c].decode("utf-8"), data[c : c + 4 * AHEAD].decode("utf-8", "ignore")[:AHEAD]
                out["base"].append(chars_before - len(head))
                out["begin"].append(len(head))
                out["stop"].append(len(head) + len(body))
                out["first"].append(k == 0)
                out["last"].append((k + 1) * size >= length)
                out["chunk"].append(head + body + tail)
            item = pa.StructArray.from_arrays([batch.column("path")], ["path"])
            kinds = {"base": pa.int64(), "begin": pa.int32(), "stop": pa.int32(), "first": pa.bool_(), "last": pa.bool_(), "chunk": pa.string()}
            yield pa.RecordBatch.from_arrays([item, batch.column("range_no"), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["item", "range_no", *out])

    counted = parts.mapInArrow(count, "path string, length bigint, range_no bigint, chars bigint")
    before = F.coalesce(F.sum("chars").over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("chars_before", before).drop("chars").repartition("path", "range_no")
    ranges = placed.mapInArrow(load, "item struct<path:string>, range_no bigint, base bigint, begin int, stop int, first boolean, last boolean, chunk string")
    return numbered(piece_rows(ranges, most, back), Workspace(spark, "pieces")).select("item.path", "piece_no", "piece_start", "piece_end", "piece_text")
