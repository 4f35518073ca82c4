"""Problem 7: evaluation texts that leaked into training text.

Method: template canonicalisation. Words become typed placeholders (numbers, measures, units, names) or stay literal, a
function of the lower-cased word alone, so equal words always have equal templates. Windows are hash-joined on their
template and their slots, in one of two forms: the slots' words (a verbatim leak), or the pattern in which they repeat,
which two windows share exactly if their slots map one to one (a re-parameterised item).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.textarrays import WORD_BASE, U, code_points, kinds, mix, window_hashes, word_arrays, word_edges
from lexmill.session import Workspace, spread

WIDTH = 13
#: Windows of items that one pass over the corpus takes and broadcasts, 24 bytes each; more are taken in further passes.
WINDOWS_A_PASS = 1_000_000
#: Literal words that are broadcast, 8 bytes each; more are joined to the words of each text instead.
BROADCAST_LITERALS = 2_000_000
#: Fewest literal words of a template by which a re-parameterised item is told, and fewest words of such an item.
LITERALS_A_WINDOW, SHORTEST = 4, 6
#: Code points handled at once.
POINTS = 4 << 20
NUMBER, UNIT, NAME = (mix(np.array([k], U))[0] for k in (0xA1, 0xA2, 0xA3))

# Units of measure, as lower-cased words.
UNITS = (
    "mm cm m km nm in ft yd mi mile miles inch inches foot feet metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms tonne tonnes ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent "
    "hz khz mhz ghz w kw mw gw kwh v a k c f pa kpa bar usd eur gbp"
).split()


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that word_arrays gives each of the words (maximal runs, lower case)."""
    return word_arrays(code_points(" ".join(words)))[1] if words else np.empty(0, U)


def typed_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and whether it is a number, of each word, digits parted by single full stops or commas being one
    number; and a placeholder of its own for measures (digits, then letters: it tells the letters), 0 for other words."""
    start, hashed, digits = word_arrays(points)
    if not len(start):
        return start, hashed, digits, np.empty(0, U)
    kind, _, end = word_edges(points)
    size = end - start
    at = np.flatnonzero(kind > 0)
    first = np.cumsum(size) - size
    letter = kind[at] == 1
    n_digits = np.add.reduceat((~letter).astype(np.int64), first)
    place = np.arange(len(at)) - np.repeat(first, size)
    # digits first, then letters only
    mixed = (n_digits > 0) & (n_digits < size) & np.logical_and.reduceat(letter == (place >= np.repeat(n_digits, size)), first)
    with np.errstate(over="ignore"):
        tail = np.where(letter, mix(points[at].astype(U) | (np.maximum(place - np.repeat(n_digits, size), 0).astype(U) << U(21))), U(0))
        measure = np.where(mixed, mix(np.add.reduceat(tail, first) ^ NUMBER), U(0))
        near = np.r_[False, digits[:-1] & digits[1:] & (start[1:] - end[:-1] == 1) & np.isin(points[end[:-1]], (ord("."), ord(",")))]
        head = np.flatnonzero(~near)
        order = np.arange(len(start)) - np.repeat(head, np.diff(np.r_[head, len(start)]))
        joined = np.add.reduceat(np.where(order > 0, mix(hashed + order.astype(U)), hashed), head)
    return start[head], joined, digits[head], measure[head]


def among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def in_pieces(text: str, width: int, most: int) -> Iterator[str]:
    """The text in stretches of about `most` characters at most, cut where no word or number is, each of which repeats
    more words of the one before than a window holds."""
    at, size = 0, most
    while len(text) - at > size:
        points = code_points(text[at : at + size])
        gaps = np.flatnonzero((kinds()[points] == 0) & ~np.isin(points, (ord("."), ord(","))))
        starts = word_edges(points[: gaps[-1] + 1])[1] if len(gaps) else gaps
        if len(starts) <= 8 * width:
            size *= 2
            continue
        yield text[at : at + int(gaps[-1]) + 1]
        at, size = at + int(starts[-8 * width]), most
    yield text[at:]


def flat_texts(texts: list[str | None], width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, row of each stretch, its start) of lower-cased texts, about `most` code points at once."""
    parts: list[str] = []
    rows: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return code_points("".join(parts)), np.array(rows), np.cumsum(lengths) - lengths

    for row, text in enumerate(texts):
        for piece in in_pieces(text.lower(), width, most) if text else ():
            if size and size + len(piece) > most:
                yield flush()
                parts, rows, size = [], [], 0
            parts.append(piece + "\n")
            rows.append(row)
            size += len(piece) + 1
    if parts:
        yield flush()


def slot_hashes(shape: np.ndarray, words: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows (a row each): hash of the slots' words, and hash of the places at which each slot's word came first."""
    places = np.arange(words.shape[1], dtype=U)
    with np.errstate(over="ignore"):
        values = np.where(slot, mix(words + (places << U(56))), U(0)).sum(1, dtype=U)
        first = np.empty(words.shape, U)
        for k in range(words.shape[1]):
            first[:, k] = np.argmax((words[:, : k + 1] == words[:, k : k + 1]) & slot[:, : k + 1], axis=1)
        pattern = np.where(slot, mix(first + (places << U(8)) + U(1)), U(0)).sum(1, dtype=U)
    return values, pattern


def windows_of(texts: list[str | None], own: list[list[int]] | None, literals: np.ndarray, units: np.ndarray, wanted: np.ndarray | None, widths: list[int], typed: bool, whole: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(width, row, template, values, pattern) of each window, or of those whose template is wanted. Literal words are the given
    ones or, with `own`, those of each text. `typed` joins numbers and keeps measures; it leaves out windows of few
    literal words. `whole` takes widths but the greatest only for texts of exactly that many words."""
    for points, rows, starts in flat_texts(texts, max(widths), POINTS):
        if typed:
            at, words, digits, measure = typed_words(points)
        else:
            (at, words, digits), measure = word_arrays(points), None
        if not len(words):
            continue
        stretch = np.searchsorted(starts, at, "right") - 1
        row = rows[stretch]
        if own is None:
            literal = among(literals, words)
        else:
            with np.errstate(over="ignore"):
                pairs = [np.array(own[r] or [], np.int64).view(U) ^ mix(np.array([r], U)) for r in np.unique(rows)]
                literal = among(np.sort(np.concatenate(pairs)), words ^ mix(row.astype(U)))
        shape = np.where(literal, words, NAME)
        shape = np.where(among(units, words), UNIT, shape)
        if typed:
            shape = np.where(measure > 0, measure, shape)
        shape = np.where(digits, NUMBER, shape)
        slot = (shape == NUMBER) | (shape == UNIT) | (shape == NAME)
        if typed:
            slot |= measure > 0
        for width in widths:
            if len(words) < width:
                continue
            keys = window_hashes(shape, width, WORD_BASE)
            good = stretch[: len(keys)] == stretch[width - 1 :]
            if whole and width < max(widths):
                good &= np.bincount(stretch, minlength=len(rows))[stretch[: len(keys)]] == width
            if typed:
                solid = np.r_[0, np.cumsum(~slot)]
                good &= solid[width:] - solid[:-width] >= min(LITERALS_A_WINDOW, width // 2)
                keys = mix(keys + U(width))
            if wanted is not None:
                good &= among(wanted, keys)
            pick = np.flatnonzero(good)
            for begin in range(0, len(pick), 1 << 18):
                part = pick[begin : begin + (1 << 18)]
                span = part[:, None] + np.arange(width)
                yield width, row[part], keys[part], *slot_hashes(shape[span], words[span], slot[span])


def window_rows(df: DataFrame, key: str, literals: np.ndarray, wanted: np.ndarray | None, widths: list[int], typed: bool, whole: bool = False) -> DataFrame:
    """Windows of each row of (key, text and, where literals aren't broadcast, own): key, template, values, pattern, width."""
    shared = df.sparkSession.sparkContext.broadcast((literals, np.sort(word_hash(UNITS)), wanted))
    kind = df.schema[key].dataType.simpleString()
    has_own = "own" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literals, units, wanted = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                own = part.column(2).to_pylist() if has_own else None
                for size, row, template, values, pattern in windows_of(part.column(1).to_pylist(), own, literals, units, wanted, widths, typed, whole):
                    once = np.unique(np.stack([row.astype(U), template, values]), axis=1, return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[once])), *(pa.array(x[once].view(np.int64)) for x in (template, values, pattern)), pa.array(np.full(len(once), size, np.int32))], names=[key, "template", "values", "pattern", "width"])

    return df.mapInArrow(run, f"`{key}` {kind}, template bigint, values bigint, pattern bigint, width int")


def literal_hashes(items: DataFrame, text: str) -> DataFrame:
    """Hashes of the words that some item writes in lower case; the other words of items and corpus are names."""
    words = items.select(F.explode(F.split(F.col(text), r"[^\p{L}\p{N}]+")).alias("w")).where("w != '' and w = lower(w)").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(batch.column(0).to_pylist()).view(np.int64))], names=["word"])

    return words.mapInArrow(run, "word bigint").distinct()


def with_own_literals(df: DataFrame, key: str, text: str, literals: DataFrame, work: Workspace) -> DataFrame:
    """key, text and `own`, the literal words among the row's words: what a broadcast of all of them would tell, by a join
    on (word, salt), so that no common word is one task's."""
    base = work.write(df.select(F.monotonically_increasing_id().alias("rid"), key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, words = [], []
            for rid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in in_pieces(t.lower(), WIDTH, POINTS) if t else ():
                    own = np.unique(word_arrays(code_points(piece))[1])
                    words.append(own)
                    rids.append(np.full(len(own), rid))
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids)), pa.array(np.concatenate(words).view(np.int64))], names=["rid", "word"])

    salts = 16
    met = base.select("rid", text).mapInArrow(run, "rid bigint, word bigint").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
    known = literals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    own = met.join(known, ["word", "salt"], "left_semi").groupBy("rid").agg(F.collect_set("word").alias("own"))
    return base.join(own, "rid", "left").select(key, text, F.coalesce("own", F.array().cast("array<bigint>")).alias("own"))


def matches(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, text: str, widths: list[int], typed: bool) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each pass: the windows of some items, few enough for a broadcast (WINDOWS_A_PASS), and the windows of the corpus
    that have one of their templates. The corpus is read once a pass and isn't shuffled."""
    work = Workspace(docs.sparkSession, "leakage")
    known = literal_hashes(items, text)
    found = known.limit(BROADCAST_LITERALS + 1).toPandas()["word"].to_numpy(np.int64)
    # the items' scan isn't spread over cores, as it is small; the corpus is
    given, corpus = items.select(item_key, text), spread(docs.select(doc_key, text), doc_key)
    if len(found) > BROADCAST_LITERALS:
        known, found = work.write(known), np.empty(0, np.int64)
        given, corpus = with_own_literals(given, item_key, text, known, work), with_own_literals(corpus, doc_key, text, known, work)
    literals = np.sort(found.view(U))
    left = work.write(window_rows(given, item_key, literals, None, widths, typed, True).distinct())
    passes = max(1, -(-left.count() // WINDOWS_A_PASS))
    for k in range(passes):
        own = left.where(F.pmod(F.xxhash64("template"), F.lit(passes)) == k) if passes > 1 else left
        told = own.select("template", "width").distinct().toPandas()
        wanted = np.unique(told["template"].to_numpy(np.int64).view(U))
        yield own, window_rows(corpus, doc_key, literals, wanted, sorted(set(told["width"])) or widths, typed)


def leaks(items: DataFrame, docs: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Pairs of item and document that share `width` consecutive words or more, once each: their windows have one template
    and the same words in its slots. Null texts, and texts of fewer than `width` words, give no row; repeated rows give
    one case; other columns are ignored."""
    out: DataFrame | None = None
    for own, found in matches(items, docs, item_key, doc_key, text, [width], False):
        joined = found.join(own.select(item_key, "template", "values").distinct().hint("broadcast"), ["template", "values"]).select(item_key, doc_key)
        out = joined if out is None else out.unionAll(joined)
    return out.distinct()


def reparameterised(items: DataFrame, docs: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Pairs of which a window of one template maps its slots one to one, and no window is verbatim; n_windows counts the
    joined windows, judged one by one, as a document may hold an item several times.

    Numbers with decimals or grouped digits are one word here, and digits with letters behind them ("15km", "7th") a
    measure. An item of SHORTEST words or more but fewer than `width` has one window, the whole of it. Windows with fewer
    than LITERALS_A_WINDOW literal words (half their width, if that is less) tell nothing and don't count: a table of
    numbers is like any other. Null and shorter texts give no row; repeated rows count once."""
    out: DataFrame | None = None
    work = Workspace(docs.sparkSession, "reparameterised")
    for own, found in matches(items, docs, item_key, doc_key, text, [*range(min(SHORTEST, width), width), width], True):
        found = work.write(found.distinct())
        fits = found.groupBy(doc_key, "template", "pattern").agg(F.count("*").alias("n")).join(F.broadcast(own.groupBy(item_key, "template", "pattern").agg(F.count("*").alias("m"))), ["template", "pattern"])
        exact = found.join(own.select(item_key, "template", "values").hint("broadcast"), ["template", "values"]).select(item_key, doc_key, F.lit(True).alias("exact"), F.lit(0).alias("n"))
        both = fits.select(item_key, doc_key, F.lit(False).alias("exact"), (F.col("n") * F.col("m")).alias("n")).unionAll(exact)
        out = both if out is None else out.unionAll(both)
    told = out.groupBy(item_key, doc_key).agg(F.max("exact").alias("exact"), F.sum("n").alias("n_windows"))
    return told.where("not exact").drop("exact")
