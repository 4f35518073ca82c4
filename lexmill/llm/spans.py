"""Problem 8: long exact spans that records share.

Method: an FM-index per shard; backward search over wavelet trees gives, for streamed documents, the ends of their
matches with other pages, and intervals of at least the threshold are reported.

What reaches the shards is found first, without loss: every stretch of `least` characters holds, in whatever document,
the window minimum of the same hashed k-gram (an anchor). Anchors that occur on one page only can't lie in a shared
stretch. Around each other anchor, the segment of all stretches that contain it goes to the anchor's shard; equal
segments (revisions of a page repeat them) are one class there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.textarrays import CHAR_BASE, U, batches_of_texts, code_points, mix, sliding_min, window_hashes
from lexmill.session import Workspace, broadcast_if_small, spread

LEAST = 200
GRAM = 64
#: Segment classes a shard should hold, and classes of one anchor beyond which the anchor is hot.
CLASSES_A_SHARD, HOT = 1500, 4000
PLACE = U((1 << 24) - 1)


def anchors(texts: list[str | None], least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, hash) of the window minima of every text."""
    wide = least - gram + 1
    for points, rows, starts, offsets in batches_of_texts(texts, 4 << 20, least - 1):
        if len(points) < least:
            continue
        hashed = window_hashes(mix(points), gram, CHAR_BASE)
        low = sliding_min((hashed & ~PLACE) | np.arange(len(hashed), dtype=U), wide)
        stretch = np.repeat(np.arange(len(rows)), np.diff(starts))
        whole = stretch[: len(low)] == stretch[least - 1 :]
        at = np.unique(low[whole] & PLACE).astype(np.int64)
        own = stretch[at]
        yield rows[own], at - starts[own] + offsets[own], hashed[at].view(np.int64)


def anchor_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                for row, at, hashed in anchors(part.column(2).to_pylist(), least, gram):
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(hashed)], names=["doc", "page", "at", "anchor"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, f"doc {kinds['doc']}, page {kinds['page']}, at int, anchor bigint")


def segment_rows(found: DataFrame, least: int, gram: int) -> DataFrame:
    """From (doc, page, text, places: array of (at, anchor)): each segment's start, class and, once a batch, its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc", "page", "start", "class", "anchor", "segment"]
            rows, start, classes, anchor, segment = [], [], [], [], []
            seen: dict[tuple[int, str], bytes] = {}
            for k, (text, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for place in places:
                    begin = max(0, place["at"] + gram - least)
                    own = text[begin : place["at"] + least]
                    key = seen.get((place["anchor"], own))
                    rows.append(k)
                    start.append(begin)
                    anchor.append(place["anchor"])
                    segment.append(None if key else own)
                    if key is None:
                        key = seen[(place["anchor"], own)] = hashlib.blake2b(f"{place['anchor']} {own}".encode("utf-8", "surrogatepass"), digest_size=12).digest()
                    classes.append(key)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(classes, pa.binary()), pa.array(anchor, pa.int64()), pa.array(segment, pa.string())], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.mapInArrow(run, f"doc {kinds['doc']}, page {kinds['page']}, start int, class binary, anchor bigint, segment string")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols or more, by prefix doubling."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    size = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(size):
        key <<= bits
        key[: n - k] |= symbols[k:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        size *= 2


class WaveletTree:
    """A wavelet tree in matrix form over packed bits: level k holds bit (levels - 1 - k) of every symbol, zeros first."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.words, self.blocks, self.zeros = [], [], []
        now = symbols
        for k in range(levels):
            bit = (now >> (levels - 1 - k)) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(U)
            self.words.append(words)
            self.blocks.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix [0, at) ends among the last level's run of the symbol; the difference of two is a rank."""
        for k in range(self.levels):
            word = at >> 6
            below = (U(1) << (at & 63).astype(U)) - U(1)
            ones = self.blocks[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


class FmIndex:
    """FM-index of some texts with a label each; labels of SA neighbours tell if an interval holds another label."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, sigma: int, depth: int):
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        flat = np.zeros(int(size.sum()), np.int64)
        ends = np.cumsum(size)
        flat[np.ones(len(flat), bool) & ~np.isin(np.arange(len(flat)), ends - 1)] = np.concatenate(texts)
        order = suffix_order(flat, depth)
        self.n = len(flat)
        self.levels = max(1, int(sigma).bit_length())
        self.tree = WaveletTree(flat[order - 1], self.levels)
        every = np.arange(sigma + 1)
        self.base = np.cumsum(np.bincount(flat, minlength=sigma + 1)) - np.bincount(flat, minlength=sigma + 1) - self.tree.place(every, np.zeros(sigma + 1, np.int64))
        self.label = np.repeat(labels, size)[order]
        change = np.flatnonzero(np.r_[self.label[1:] != self.label[:-1], True]) + 1
        self.until = np.repeat(change, np.diff(np.r_[0, change]))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with the symbol put before them."""
        both = self.tree.place(np.r_[symbol, symbol], np.r_[low, high]) + np.r_[self.base[symbol], self.base[symbol]]
        return both[: len(low)], both[len(low) :]

    def other(self, low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the interval holds an entry of another label."""
        at = np.minimum(low, self.n - 1)
        return (low < high) & ((self.label[at] != label) | (self.until[at] < high))


def first_shared(index: FmIndex, texts: list[np.ndarray], labels: np.ndarray, least: int) -> np.ndarray:
    """Of each text, the first start of a stretch of `least` symbols that another label has too; -1 if none has. Each
    window is searched backward from its end; its matching statistic there, m < least, rules out every start that would
    contain the m + 1 symbols, so the window moves on by least - m."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat, base = np.concatenate(texts), np.cumsum(size) - size
    out = np.full(len(texts), -1)
    lane = np.flatnonzero((size >= least) & (labels >= 0))
    p, m = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    while len(lane):
        a, b = index.extend(low, high, flat[base[lane] + p + least - 1 - m])
        good = index.other(a, b, labels[lane])
        m = np.where(good, m + 1, m)
        won = m >= least
        out[lane[won]] = p[won]
        p = np.where(good, p, p + least - m)
        low, high, m = np.where(good, a, 0), np.where(good, b, index.n), np.where(good, m, 0)
        keep = ~won & (p + least <= size[lane])
        lane, p, m, low, high = lane[keep], p[keep], m[keep], low[keep], high[keep]
    return out


def search_shard(segments: list[str], labels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, the stretch [begin, end) that other labels share; begin -1 if none. Label -1 is several pages.
    One index is over the segments, for the first start; one over them reversed, for the last end."""
    points = [code_points(s) for s in segments]
    alphabet = np.unique(np.concatenate(points))
    texts = [np.searchsorted(alphabet, x) + 1 for x in points]
    sides = []
    for turned in (texts, [x[::-1] for x in texts]):
        index = FmIndex(turned, labels, len(alphabet), 2 * least)
        sides.append(first_shared(index, turned, labels, least))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin, end = sides[0], size - sides[1]
    whole = (labels < 0) & (size >= least)
    return np.where(whole, 0, begin), np.where(whole, size, end)


def shard_stretches(classes: DataFrame, least: int, shards: int) -> DataFrame:
    """From (shard, class, segment, page or -1 per shard-local label): class, begin, end."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pages = rows["first_page"].to_numpy()
        _, label = np.unique(pages, return_inverse=True)
        label = np.where(rows["several"].to_numpy(), -1, label)
        begin, end = search_shard(rows["segment"].tolist(), label, least)
        out = pd.DataFrame({"class": rows["class"], "begin": begin.astype(np.int32), "end": end.astype(np.int32)})
        return out[out["begin"] >= 0]

    # so many partitions that no task gets several shards where cores are free; adaptive merging would go by bytes
    return classes.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "class binary, begin int, end int")


def hot_stretches(classes: DataFrame, least: int) -> DataFrame:
    """The same for anchors with too many distinct segments for one index: windows compared by hash, aggregated before
    the shuffle, so no anchor's segments ever meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                hashed = window_hashes(mix(code_points(text)), least, CHAR_BASE)
                n = len(hashed)
                same = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), pa.array(hashed.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), batch.column(2).take(same), batch.column(3).take(same)], names=["class", "window", "begin", "first_page", "last_page"])

    page = classes.schema["first_page"].dataType.simpleString()
    windows = classes.select("class", "segment", "first_page", "last_page").mapInArrow(run, f"class binary, window bigint, begin int, first_page {page}, last_page {page}")
    shared = windows.groupBy("window").agg(F.min("first_page").alias("a"), F.max("last_page").alias("b")).where("a < b").select("window")
    return windows.join(shared, "window").groupBy("class").agg(F.min("begin").alias("begin"), (F.max("begin") + least).cast("int").alias("end"))


def merge_stretches(df: DataFrame) -> DataFrame:
    """Per doc, stretches (begin, end) that overlap or touch joined into one: doc, span_start, span_end."""
    before = Window.partitionBy("doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True))
    return (
        df.withColumn("opens", opens.cast("int"))
        .withColumn("run", F.sum("opens").over(upto))
        .groupBy("doc", "run")
        .agg(F.min("begin").cast("int").alias("span_start"), F.max("end").cast("int").alias("span_end"))
        .drop("run")
    )


def shared_spans(docs: DataFrame, doc_key: str = "doc_id", page_key: str = "page_id", text: str = "text", least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc key, span_start, span_end (code points from 0, end exclusive) of the maximal stretches covered by substrings
    of `least` or more characters that occur verbatim in a record of another page. Null, empty and shorter texts give no
    row; records without a page count as a page of their own each; repeated rows give one case; other columns are
    ignored."""
    spark = docs.sparkSession
    work = Workspace(spark, "spans")
    base = docs.select(F.col(doc_key).alias("doc"), F.coalesce(F.col(page_key).cast("string"), F.concat(F.lit("doc "), F.col(doc_key).cast("string"))).alias("page"), F.col(text).alias("text"))
    base = base.where(F.length("text") >= least)
    marks = work.write(anchor_rows(spread(base, "doc"), least, gram))
    shared = marks.groupBy("anchor").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b").select("anchor")
    places = marks.join(shared, "anchor", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("at", "anchor")).alias("places"))
    places = work.write(places)
    sizes = places.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("m")).first()
    small = broadcast_if_small(places, sizes.n * 40 + sizes.m * 16, 1)
    segments = work.write(segment_rows(base.join(small, "doc").select("doc", "page", "text", "places"), least, gram))
    classes = segments.groupBy("class").agg(F.min("anchor").alias("anchor"), F.max("segment").alias("segment"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    classes = work.write(classes.withColumn("several", F.col("first_page") < F.col("last_page")))
    counts = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.max("several").alias("any_several")).where("n > 1 or any_several")
    counted = classes.join(counts, "anchor")
    total = classes.count()
    shards = max(1, -(-total // CLASSES_A_SHARD))
    normal = counted.where(F.col("n") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    found = shard_stretches(normal.select("shard", "class", "segment", "first_page", "several"), least, shards)
    if counts.where(F.col("n") > hot).limit(1).count():
        found = found.unionAll(hot_stretches(counted.where(F.col("n") > hot), least))
    placed = segments.join(found, "class").select("doc", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end")).distinct()
    return merge_stretches(placed).select(F.col("doc").alias(doc_key), "span_start", "span_end")


def shared_share(docs: DataFrame, spans: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per record: its length, how many of its characters other pages share, and that share of the whole."""
    sums = spans.groupBy(doc_key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sized = docs.groupBy(doc_key).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    out = sized.join(sums, doc_key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("long")).withColumn("n_spans", F.coalesce("n_spans", F.lit(0)).cast("long"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
