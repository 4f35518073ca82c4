"""Problem 1: near-duplicate records with small edits.

Method: vertical partitioning. The word n-grams of all texts have one global order, rarest first; that order is cut into
fragments, and each record into its segments. What lies of a record's prefix in a fragment is joined there, in blocks
where an n-gram is hot; what two segments can share at most is bounded in each fragment and summed, and for the pairs left
the partial overlaps of the fragments are counted separately and summed per pair.

Texts of the same words are one class throughout. The order goes by a sketch of fixed size of the n-grams' counts, so it
needs no join; any order gives the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.textarrays import WORD_BASE, U, code_points, mix, window_hashes
from lexmill.session import Workspace, shuffles_removed

WIDTH, THRESHOLD, FRAGMENTS = 5, "0.8", 4
#: Records of one n-gram that one block of the prefix join holds; n-grams with more are split into blocks.
BLOCK = 4096
#: Copies of one text that one block holds when pairs of records are listed.
COPIES = 512
#: Counters of the sketch, as a power of two, and counters in one row of it.
SKETCH_BITS, PAGE = 20, 4096
#: Code points, postings and meetings that one step of the array code holds.
POINTS, ROWS, MEETINGS = 2 << 20, 1 << 17, 1 << 20
#: Turns in which the n-grams are joined, by their hash, so that a turn's postings alone lie on disk; postings that a task
#: packs at once; n-grams that are split into blocks, at most.
TURNS, HELD, HOT = 3, 1 << 20, 1 << 20


def words_of(text: str) -> Column:
    """The maximal runs of letters or digits of the lower-cased text, parted by spaces."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))


def has_words(text: str, least: int) -> Column:
    """Whether the text has that many words, told by one look from its start."""
    return F.lower(F.col(text)).rlike(rf"\A[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}]++[^\p{{L}}\p{{N}}]++){{{max(least, 1) - 1}}}[\p{{L}}\p{{N}}]")


def versions_of(df: DataFrame, keys: list[str], text: str, least_words: int) -> DataFrame:
    """keys, class (hash of the words) and words of each row with enough words."""
    return df.where(has_words(text, least_words)).select(*keys, words_of(text).alias("words")).withColumn("class", F.unhex(F.md5("words")))


def gram_arrays(texts: list[str], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row from there, hash) of the n-grams of texts whose words are parted by spaces, repeats included."""
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) < POINTS):
            size += len(texts[stop]) + 1
            stop += 1
        points = code_points("\n".join(texts[begin:stop]) + "\n")
        end_of_text = np.flatnonzero(points == 10)
        inside = (points != 32) & (points != 10)
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.cumsum(end - start) - (end - start)
        place = np.arange(int((end - start).sum())) - np.repeat(first, end - start)
        with np.errstate(over="ignore"):
            word = np.add.reduceat(mix(points[inside].astype(U) | (place.astype(U) << U(21))), first) if len(first) else np.empty(0, U)
        row = np.searchsorted(end_of_text, start)
        grams = window_hashes(word, width, WORD_BASE)
        whole = row[: len(grams)] == row[width - 1 :] if len(grams) else np.zeros(0, bool)
        yield begin, row[: len(grams)][whole], grams[whole]
        begin = stop


def sketch(classes: DataFrame, width: int) -> np.ndarray:
    """How often n-grams of each hash bucket occur: 2 ** SKETCH_BITS counters, whatever the input's size. Each task adds
    up its own, in a sketch's memory; so do those that merge them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, grams in gram_arrays(batch.column(0).to_pylist(), width):
                total += np.bincount((grams >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        pages = total.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([p.tobytes() for p in pages[used]], pa.binary())], names=["page", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(counts.as_buffer(), np.int64)
                total[page] = total[page] + own if page in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["page", "counts"])

    kind = "page int, counts binary"
    out = np.zeros((1 << SKETCH_BITS) // PAGE * PAGE, np.int64).reshape(-1, PAGE)
    with shuffles_removed(classes.sparkSession):
        rows = classes.select("words").mapInArrow(count, kind).repartition("page").mapInArrow(merge, kind).collect()
    for r in rows:
        out[r.page] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The counts on a scale of eighths of a doubling, in a byte; 0 for n-grams that occur once at most."""
    return np.where(counts > 1, np.minimum(255, np.floor(np.log2(np.maximum(counts, 2)) * 8)), 0).astype(np.uint8)


def pivots_of(counts: np.ndarray, levels: np.ndarray, fragments: int) -> np.ndarray:
    """The levels at which the order is cut, so that each fragment has about as many occurrences."""
    weight = np.cumsum(np.bincount(levels, np.where(levels > 0, counts, 0), 256))
    return np.array([int(np.searchsorted(weight, weight[-1] * k / fragments)) for k in range(1, fragments)], np.int64)


def ordered(texts: list[str], width: int, levels: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, n-gram, its place in the row's order, its fragment) of the distinct n-grams of each text, in the global order.
    The fragment is -1 for n-grams that occur nowhere else; they come first."""
    for begin, row, gram in gram_arrays(texts, width):
        level = levels[(gram >> U(64 - SKETCH_BITS)).astype(np.int64)]
        # by (row, level, n-gram) in one number, unless it is equal for two n-grams
        bits = max(1, int(row[-1]).bit_length()) if len(row) else 1
        key = row.astype(U) << U(64 - bits) | level.astype(U) << U(56 - bits) | gram >> U(8 + bits)
        order = np.argsort(key)
        key, sorted_gram = key[order], gram[order]
        if ((key[1:] == key[:-1]) & (sorted_gram[1:] != sorted_gram[:-1])).any():
            order = np.lexsort((gram, level, row))
        row, gram, level = row[order], gram[order], level[order]
        once = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
        row, gram, level = row[once], gram[once], level[once].astype(np.int64)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        yield row + begin, gram, np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])), np.where(level > 0, np.searchsorted(pivots, level), -1)


def doublings(n: np.ndarray, fragments: int) -> np.ndarray:
    """How often the 16 bits that a segment's parities have at least are doubled: two bits for each n-gram of the record."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (8 * fragments)))).astype(np.int64)


def planes(values: np.ndarray, kind: type) -> bytes:
    """Numbers by the significance of their bytes, so that equal ones lie together."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T.tobytes()


#: Postings of one part and pass, and the bounds of their records once each: `records` are id (as differences), n and the sizes
#: of the segments, then for each posting the key of its n-gram and cell (as differences), record, place and side, then the
#: parities of all segments, all compressed; `size` is the bytes without compression.
POSTINGS = "part int, postings int, records int, size int, body binary"
POSTING_TYPES = (np.uint32, np.uint32, np.uint32, np.uint8)


def packed(part: int, key: np.ndarray, record: np.ndarray, at: np.ndarray, side: np.ndarray, held: dict[str, np.ndarray], fragments: int) -> tuple:
    """A row of POSTINGS, of postings in order of key; held has id, n, sizes, start and bits of all records at hand."""
    own, record = np.unique(record, return_inverse=True)
    length = fragments << doublings(held["n"][own], fragments)
    begin = np.cumsum(length) - length
    bits = held["bits"][np.arange(int(length.sum())) + np.repeat(held["start"][own] - begin, length)]
    body = planes(np.diff(held["id"][own], prepend=0), np.int64) + planes(held["n"][own], np.uint32) + planes(held["sizes"][own].ravel(), np.uint32)
    body += b"".join(planes(v, t) for v, t in zip((np.diff(key, prepend=key[:1] * 0), record, at, side), POSTING_TYPES)) + bits.tobytes()
    return part, len(key), len(own), len(body), pa.compress(body, "zstd", asbytes=True)


def unpacked(rows: pa.RecordBatch, fragments: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """([key, record, at, side], [id, n, sizes, bits]) of each row of POSTINGS."""
    for p, r, size, body in zip(*(rows.column(k).to_pylist() for k in ("postings", "records", "size", "body"))):
        raw, at = np.frombuffer(pa.decompress(body, size, "zstd"), np.uint8), 0
        out = []
        for count, kind in ((r, np.int64), (r, np.uint32), (r * fragments, np.uint32), *((p, t) for t in POSTING_TYPES)):
            width = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(raw[at : at + count * width].reshape(width, count).T).view(kind).ravel())
            at += count * width
        ids, n, sizes, key, record, place, side = out
        yield [np.cumsum(key, dtype=np.uint32), record.astype(np.int64), place.astype(np.int64), side], [np.cumsum(ids), n.astype(np.int64), sizes.astype(np.int64).reshape(-1, fragments), raw[at:].copy().view(np.uint16)]


def postings(classes: DataFrame, width: int, levels: np.ndarray, pivots: np.ndarray, hot: tuple[np.ndarray, np.ndarray], t: Fraction, turn: int, turns: int, parts: int) -> DataFrame:
    """POSTINGS of the prefix of each class, as far as its n-grams have that turn."""
    fragments = len(pivots) + 1
    names = [x.split()[0] for x in POSTINGS.split(", ")]
    shared = classes.sparkSession.sparkContext.broadcast((levels, pivots, hot))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], ...]]:
        """(postings, records) of some texts."""
        levels, pivots, hot = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, gram, at, fragment in ordered(batch.column(1).to_pylist(), width, levels, pivots):
                if not len(row):
                    continue
                low, rows = row[0], int(row[-1] - row[0]) + 1
                row = row - low
                n = np.bincount(row, minlength=rows)
                prefix = n + 1 + (-n * t.numerator // t.denominator)
                used = fragment >= 0
                spread = mix(gram)
                pick = np.flatnonzero(used & (at < prefix[row]) & (spread % U(turns) == U(turn)))
                sizes = np.bincount((row * fragments + fragment)[used], minlength=rows * fragments).reshape(rows, fragments)
                double = doublings(n, fragments)
                start = np.cumsum(fragments << double) - (fragments << double)
                word = start[row] + (fragment << double[row]) + ((gram >> U(4)).astype(np.int64) & ((1 << double[row]) - 1))
                odd = np.bincount((word * 16 + (gram & U(15)).astype(np.int64))[used], minlength=16 * int((fragments << double).sum())) & 1
                record, place, side, cell = row[pick], at[pick], np.full(len(pick), 2, np.uint8), np.zeros(len(pick), np.int64)
                spread, own = spread[pick], ids[low + record]
                if len(hot[0]) and len(pick):
                    found = np.minimum(np.searchsorted(hot[0], gram[pick]), len(hot[0]) - 1)
                    blocks = np.where(hot[0][found] == gram[pick], hot[1][found], 1)
                    copy = np.repeat(np.arange(len(pick)), blocks)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    block = (mix(own) % blocks.astype(U)).astype(np.int64)[copy]
                    record, place, spread = record[copy], place[copy], spread[copy]
                    side = np.where(block == other, 2, np.where(block < other, 0, 1)).astype(np.uint8)
                    cell = np.minimum(block, other) << 31 | np.maximum(block, other)
                with np.errstate(over="ignore"):
                    spread = mix(spread + mix(cell))
                yield {"key": spread.astype(np.uint32), "part": ((spread >> U(32)) % U(parts)).astype(np.int32), "record": record, "at": place, "side": side}, {"id": ids[low : low + rows], "n": n, "sizes": sizes, "start": start, "bits": np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint16)}

    def out(held: list[tuple[dict[str, np.ndarray], ...]]) -> pa.RecordBatch:
        first, begin = np.cumsum([0] + [len(r["n"]) for _, r in held]), np.cumsum([0] + [len(r["bits"]) for _, r in held])
        c = {k: np.concatenate([p[k] + first[j] if k == "record" else p[k] for j, (p, _) in enumerate(held)]) for k in held[0][0]}
        records = {k: np.concatenate([r[k] + begin[j] if k == "start" else r[k] for j, (_, r) in enumerate(held)]) for k in held[0][1]}
        order = np.lexsort((c["key"], c["part"]))
        c = {k: v[order] for k, v in c.items()}
        edge = np.r_[np.flatnonzero(np.r_[True, c["part"][1:] != c["part"][:-1]]), len(order)] if len(order) else np.zeros(1, int)
        rows = [packed(int(c["part"][i]), *(c[k][i:j] for k in ("key", "record", "at", "side")), records, fragments) for i, j in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 4 else pa.int32()) for k in range(5)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for chunk in chunks(batches):
            held.append(chunk)
            size += len(chunk[0]["key"])
            if size >= HELD:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return classes.select("id", "words").mapInArrow(run, POSTINGS)


def hot_grams(classes: DataFrame, width: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that more than BLOCK classes have, in order, and the number of blocks of each; blocks are larger where there
    would be more than HOT such n-grams. Only n-grams whose counter is that high are counted."""
    risky = counts > BLOCK
    if not risky.any():
        return np.empty(0, U), np.empty(0, np.int64)
    shared = classes.sparkSession.sparkContext.broadcast(risky)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, gram in gram_arrays(batch.column(0).to_pylist(), width):
                pick = shared.value[(gram >> U(64 - SKETCH_BITS)).astype(np.int64)]
                row, gram = row[pick], gram[pick]
                order = np.lexsort((row, gram))
                row, gram = row[order], gram[order]
                once = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
                found, n = np.unique(gram[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["gram", "n"])

    work = Workspace(classes.sparkSession, "hot", tidy=True)
    hot = work.write(classes.select("words").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK))
    block = BLOCK
    while hot.where(F.col("n") > block).count() > HOT:
        block *= 2
    told = hot.where(F.col("n") > block).toArrow()
    work.clear()
    gram, n = told.column("gram").to_numpy().view(U), told.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], -(-n[order] // block)


def parities(n: np.ndarray, bits: np.ndarray, fragments: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of doublings (place of each record, parities): those of records with at least so many, folded."""
    double = doublings(n, fragments)
    length = fragments << double
    start = np.cumsum(length) - length
    out, above, upper = [], np.zeros(0, np.int64), None
    for k in range(int(double.max()), -1, -1):
        own = np.flatnonzero(double == k)
        now = bits[start[own][:, None] + np.arange(fragments << k)].reshape(len(own), fragments, 1 << k)
        if upper is not None:
            now = np.concatenate([upper[:, :, : 1 << k] ^ upper[:, :, 1 << k :], now])
        above, upper = np.r_[above, own], now
        place = np.full(len(n), -1, np.int64)
        place[above] = np.arange(len(above))
        wide = np.ascontiguousarray(now).view({1: np.uint16, 2: np.uint32}.get(1 << k, U))
        out.append((place, [np.ascontiguousarray(wide[:, f]) for f in range(fragments)]))
    return out[::-1]


def meetings(c: dict[str, np.ndarray], records: dict, t: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, n of a, n of b) of pairs that may be similar, of postings in order of (key, n of the record). Of two records the
    longer one's prefix meets a shorter prefix of the other; lengths, places and the fragments' bounds rule out most."""
    num, den = t.numerator, t.denominator
    record, at, side = c["record"], c["at"], c["side"]
    group = np.r_[0, np.cumsum(c["key"][1:] != c["key"][:-1])].astype(np.int64)
    n = records["n"][record]
    indexed = at <= n - -(-2 * n * num // (num + den))
    before = np.r_[0, np.cumsum(indexed)]
    entries = np.flatnonzero(indexed)
    left = n - at
    place = group << 32 | n
    low = before[np.searchsorted(place, group << 32 | -(-n * num // den))]
    # what is left of the longer one rules out shorter ones that are too long
    most = np.clip(left * (num + den) // num - n, 0, n)
    count = np.minimum(before[:-1], before[np.searchsorted(place, group << 32 | most, "right")]) - low
    probes = np.flatnonzero(count > 0)
    upto = np.cumsum(count[probes])
    cells = bool((side != 2).any())
    begin = 0
    while begin < len(probes):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + MEETINGS, "right")))
        own = probes[begin:stop]
        a = np.repeat(own, count[own])
        shift = np.cumsum(count[own]) - count[own]
        b = entries[np.arange(len(a)) - np.repeat(shift - low[own], count[own])]
        begin = stop
        need = -(-(n[a] + n[b]) * num // (num + den))
        good = left[b] >= need
        if cells:
            good &= (side[a] == 2) | (side[a] != side[b])
        a, b, need = record[a[good]], record[b[good]], need[good]
        # in a fragment two segments share no more than the smaller has, nor than the parities leave; the sum bounds the pair
        double = np.minimum(records["double"][a], records["double"][b])
        for k in np.flatnonzero(np.bincount(double)) if len(double) else ():
            some = double == k
            x, y, least = a[some], b[some], need[some]
            place, bits = records["parities"][k]
            rest = np.zeros(len(x), np.int64)
            smaller = [np.minimum(z[x], z[y]) for z in records["sizes"]]
            for s in smaller:
                rest += s
            for f, z in enumerate(records["sizes"]):
                own = np.bitwise_count(bits[f][place[x]] ^ bits[f][place[y]]).sum(1, dtype=np.int64)
                rest += np.minimum(0, (z[x] + z[y] - own) // 2 - smaller[f])
                keep = rest >= least
                x, y, least, rest = x[keep], y[keep], least[keep], rest[keep]
                smaller = [s[keep] for s in smaller]
            ids, size = records["id"], records["n"]
            keep = ids[x] != ids[y]
            x, y = x[keep], y[keep]
            if len(x):
                swap = ids[x] > ids[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                once = np.unique(np.stack([ids[x], ids[y]]), axis=1, return_index=True)[1]
                yield ids[x[once]], ids[y[once]], size[x[once]].astype(np.int32), size[y[once]].astype(np.int32)


def joined(rows: DataFrame, fragments: int, t: Fraction, parts: int) -> DataFrame:
    """a, b, na, nb of the pairs that meet in POSTINGS, a part in each task, some cells at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_postings, all_records, first = [], [], 0
        for batch in batches:
            for found, records in unpacked(batch, fragments):
                found[1] += first
                first += len(records[0])
                all_postings.append(found)
                all_records.append(records)
        if not all_postings:
            return
        ids, n, sizes, bits = (np.concatenate([r[k] for r in all_records]) for k in range(4))
        records = {"id": ids, "n": n, "sizes": [np.ascontiguousarray(z) for z in sizes.T], "double": doublings(n, fragments), "parities": parities(n, bits, fragments)}
        c = dict(zip(("key", "record", "at", "side"), (np.concatenate([p[k] for p in all_postings]) for k in range(4))))
        order = np.lexsort((n[c["record"]], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        begin = 0
        while begin < len(order):
            # a cell isn't cut
            stop = int(np.searchsorted(c["key"], c["key"][min(begin + ROWS, len(order)) - 1], "right"))
            for a, b, na, nb in meetings({k: v[begin:stop] for k, v in c.items()}, records, t):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(na), pa.array(nb)], names=["a", "b", "na", "nb"])
            begin = stop

    return rows.repartitionById(parts, "part").mapInArrow(run, "a bigint, b bigint, na int, nb int")


def segments(classes: DataFrame, width: int, levels: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """id, f, grams: the segment of each class in each fragment where it has one."""
    shared = classes.sparkSession.sparkContext.broadcast((levels, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, pivots = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, gram, _, fragment in ordered(batch.column(1).to_pylist(), width, levels, pivots):
                row, gram, fragment = row[fragment >= 0], gram[fragment >= 0], fragment[fragment >= 0]
                if not len(row):
                    continue
                edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(row)].astype(np.int32)), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[edge]]), pa.array(fragment[edge].astype(np.int32)), lists], names=["id", "f", "grams"])

    return classes.select("id", "words").mapInArrow(run, "id bigint, f int, grams array<bigint>")


def similar_classes(versions: DataFrame, work: Workspace, width: int, threshold: str, fragments: int) -> DataFrame:
    """versions, a table of work, is dropped once read. Pairs (a, b) of classes whose sets of `width` consecutive words have a Jaccard similarity of `threshold`
    or more, with the sizes of both sets and of their overlap."""
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    # ids are numbered once, as the table is written
    classes = versions.groupBy("class").agg(F.first("words").alias("words"))
    classes = work.write(classes.select(F.monotonically_increasing_id().alias("id"), "class", "words"))
    work.drop(versions)
    counts = sketch(classes, width)
    levels = levels_of(counts)
    pivots = pivots_of(counts, levels, fragments)
    hot = hot_grams(classes, width, counts)
    spark = classes.sparkSession
    # the work grows with the pairs that meet, not with the rows, by whose size tasks would be merged
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = [work.write(joined(postings(classes, width, levels, pivots, hot, t, k, TURNS, parts), fragments, t, parts).distinct()) for k in range(TURNS)]
    pairs = work.write(reduce(DataFrame.unionAll, met).distinct())
    for m in met:
        work.drop(m)
    paired = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    cut = work.write(segments(classes.join(paired, "id", "left_semi"), width, levels, pivots))
    # each pair's overlap counted fragment by fragment, and the partial overlaps summed
    partial = (
        pairs.join(cut.select(F.col("id").alias("a"), "f", F.col("grams").alias("ga")), "a")
        .join(cut.select(F.col("id").alias("b"), "f", F.col("grams").alias("gb")), ["b", "f"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    )
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    found = work.write(summed.where(F.col("overlap") * den >= (F.col("na") + F.col("nb") - F.col("overlap")) * num))
    names = classes.select("id", "class")
    out = found.join(names.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a").join(names.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b")
    told = work.write(out.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb", "overlap"))
    for done in (classes, pairs, cut, found):
        work.drop(done)
    return told


def near_duplicates(df: DataFrame, keys: list[str], text: str, width: int = WIDTH, threshold: str = THRESHOLD, least_words: int = 0, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has keys and class of each record; pairs has a, b, na, nb, overlap of similar classes.

    Texts that are null or have fewer than `least_words` words (or than `width`) are in no pair; records of the same
    words are one class, whose members are all similar to each other; repeated rows count once. Columns other than keys
    and text are ignored."""
    work = Workspace(df.sparkSession, "neardup", tidy=True)
    versions = work.write(versions_of(df, keys, text, max(least_words, width)))
    members = work.write(versions.select(*keys, "class").distinct())
    return members, similar_classes(versions, work, width, threshold, fragments)


def similar_pairs(members: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of different records that are similar, copies included: a_<key>, b_<key>, (a) < (b) in the keys' order.
    The rows are as many as the pairs; near_duplicates alone keeps them to classes.

    Copies of a text are listed in blocks of COPIES, so that no task has more than two blocks of a class. A class meets
    itself and those of its pairs once, so only records with several texts can bring a pair twice: those alone are made
    distinct."""
    members = members.select(F.struct(*keys).alias("key"), "class")
    several = members.groupBy("key").agg(F.count("*").alias("versions"))
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / COPIES).cast("int")
    wanted = pairs.select("a", "b").unionAll(sizes.where("size > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
    counted = lambda side: sizes.select(F.col("class").alias(side), blocks.alias(f"{side}_blocks"))
    cells = wanted.join(counted("a"), "a").join(counted("b"), "b").withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    cells = cells.where("a <> b or a_block <= b_block").select("a", "b", "a_block", "b_block")
    own = members.join(several, "key").join(sizes, "class").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    side = lambda s: own.select(F.col("class").alias(s), F.col("block").alias(f"{s}_block"), F.col("key").alias(f"{s}_key"), (F.col("versions") > 1).alias(f"{s}_many"))
    cross = cells.join(side("a"), ["a", "a_block"]).join(side("b"), ["b", "b_block"])
    # within a block both orders meet; a record whose versions fall into two classes isn't a pair with itself
    cross = cross.where(F.when((F.col("a") == F.col("b")) & (F.col("a_block") == F.col("b_block")), F.col("a_key") < F.col("b_key")).otherwise(F.col("a_key") != F.col("b_key")))
    low, high = F.least("a_key", "b_key"), F.greatest("a_key", "b_key")
    out = lambda df: df.select(*[low[k].alias(f"a_{k}") for k in keys], *[high[k].alias(f"b_{k}") for k in keys])
    again = F.col("a_many") | F.col("b_many")
    return out(cross.where(~again)).unionAll(out(cross.where(again)).distinct())


def records_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and class of each distinct record, however short its text; the class is null where the text is."""
    return df.select(*keys, F.unhex(F.md5(words_of(text))).alias("class")).distinct()


def groups(pairs: DataFrame, work: Workspace) -> DataFrame:
    """class and group (its least class) of each class in a pair: the connected components of the pairs.

    Large and small stars in turn: each round hangs the neighbours of a class on the least class among them, by an
    aggregate and a join, until nothing changes. The rounds grow with the logarithm of the largest component."""
    now, before = work.write(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), None
    while True:
        both = now.unionAll(now.select("v", "u")).distinct()
        large = both.where("v > u").join(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        new = work.write(small.select("u", F.col("m").alias("v")).unionAll(small.where("v > m").select("v", "m")).distinct())
        work.drop(now)
        now, after = new, tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("class"), F.col("v").alias("group")).unionAll(now.select("v", "v").distinct())


def links(members: DataFrame, pairs: DataFrame, keys: list[str], records: DataFrame | None = None) -> DataFrame:
    """One row a record: keys, class_id (of its exact words), n_links: records similar to it, copies included, and
    group_id: the same for records that a chain of similar ones joins. Of records (keys, class), where given, also those
    that are no members get a row, with n_links 0 and without group_id."""
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    near = both.join(sizes.select(F.col("class").alias("other"), F.col("size").alias("s")), "other").groupBy("class").agg(F.sum("s").alias("near"))
    grouped = groups(pairs, Workspace(members.sparkSession, "groups"))
    per_class = sizes.join(near, "class", "left").join(grouped, "class", "left").select("class", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("group", "class").alias("group"))
    rows = (members if records is None else records).join(per_class, "class", "left")
    return rows.select(*keys, F.lower(F.hex("class")).alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"), F.lower(F.hex("group")).alias("group_id"))
