"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

Method: batched numpy merge rounds. The symbols of many distinct words lie in one flat array; each round finds the rank
of every adjacent pair by binary search over the sorted pair keys and merges, in each word, its pair of lowest rank.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
NO_RANK = np.int32(2**31 - 1)
SHIFT = 20

# The published pre-tokenisation pattern of this vocabulary, for any text and for pure ASCII text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


@dataclass
class Merges:
    """byte_ids: id of each byte; keys: sorted left << SHIFT | right; ranks and merged run along keys."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load_merges(path: str = DEFAULT_VOCABULARY) -> Merges:
    """Reads a byte-level BPE vocabulary file; its size is bounded by the vocabulary (some 50,000 pairs)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([(ids[a] << SHIFT) | ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    letters = byte_letters()
    return Merges(
        np.array([ids[letters[b]] for b in range(256)], np.int64),
        keys[order],
        np.arange(len(pairs), dtype=np.int32)[order],
        np.array([ids[a + b] for a, b in pairs], np.int64)[order],
    )


def merge_words(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and the number of ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    wid = np.repeat(np.arange(len(words)), sizes)
    done_sym, done_wid = [], []
    while len(sym):
        first = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]])
        rank = np.full(len(sym), NO_RANK, np.int32)
        key = (sym[:-1] << SHIFT) | sym[1:]
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        hit = (m.keys[at] == key) & (wid[1:] == wid[:-1])
        rank[:-1][hit] = m.ranks[at[hit]]
        lowest = np.minimum.reduceat(rank, first)
        span = np.diff(np.r_[first, len(sym)])
        best = np.repeat(lowest, span)
        live = best != NO_RANK
        if not live.all():
            done_sym.append(sym[~live])
            done_wid.append(wid[~live])
        pick = (rank == best) & live
        # of pairs that overlap (a run of one symbol) every second one is merged, from the left
        place = np.flatnonzero(pick)
        if len(place) > 1 and (np.diff(place) == 1).any():
            head = np.r_[True, np.diff(place) != 1]
            start = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - start) % 2 == 0]
        sym = sym.copy()
        sym[place] = m.merged[at[place]]
        keep = live
        keep[place + 1] = False
        sym, wid = sym[keep], wid[keep]
    if not done_sym:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64)
    wid = np.concatenate(done_wid)
    order = np.argsort(wid, kind="stable")
    return np.concatenate(done_sym)[order].astype(np.int32), np.bincount(wid, minlength=len(words))


def take(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pool's stretches [start, start + size), one after another."""
    total = int(size.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(total)]


class Encoder:
    """Encodes texts; remembers words and lines it has seen until the memory bound, then starts afresh. The memory only
    saves work: results are the same without it."""

    def __init__(self, merges: Merges, most_words: int = 1 << 19, most_ids: int = 12 << 20):
        import regex

        self.merges, self.most_words, self.most_ids = merges, most_words, most_ids
        self.any = regex.compile(PATTERN).findall
        self.ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.newline = int(merges.byte_ids[10])
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.word_pool, self.word_start, self.word_size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        # line 0 is the lone line end
        self.lines: dict[str, int] = {"\n": 0}
        self.line_pool, self.line_start, self.line_size = np.array([self.newline], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def learn_words(self, words: list[str]) -> None:
        pool, sizes = merge_words(self.merges, [w.encode("utf-8", "surrogatepass") for w in words])
        starts = len(self.word_pool) + np.cumsum(sizes) - sizes
        self.word_pool = np.concatenate([self.word_pool, pool])
        self.word_start, self.word_size = np.concatenate([self.word_start, starts]), np.concatenate([self.word_size, sizes])

    def learn_lines(self, lines: list[str]) -> None:
        flat: list[int] = []
        counts, new, known = [], [], self.words
        for line in lines:
            for w in (found := (self.ascii if line.isascii() else self.any)(line)):
                k = known.get(w)
                if k is None:
                    known[w] = k = len(known)
                    new.append(w)
                flat.append(k)
            counts.append(len(found))
        if new:
            self.learn_words(new)
        at = np.array(flat, np.int64)
        sizes = self.word_size[at]
        pool = take(self.word_pool, self.word_start[at], sizes)
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(np.array(counts, np.int64))]
        starts = np.r_[0, ends[:-1]] + len(self.line_pool)
        self.line_size = np.concatenate([self.line_size, np.diff(np.r_[0, ends])])
        self.line_start = np.concatenate([self.line_start, starts])
        self.line_pool = np.concatenate([self.line_pool, pool])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one flat array, and the number of ids of each text."""
        if len(self.words) > self.most_words or len(self.line_pool) > self.most_ids:
            self.reset()
        refs: list[int] = []
        counts, new, lines = [], [], self.lines
        for text in texts:
            before = len(refs)
            if text:
                for line in split_lines(text):
                    k = lines.get(line)
                    if k is None:
                        lines[line] = k = len(lines)
                        new.append(line)
                    refs.append(k)
                    refs.append(0)
                refs.pop()
            counts.append(len(refs) - before)
        if new:
            self.learn_lines(new)
        at = np.array(refs, np.int64)
        sizes = self.line_size[at]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(np.array(counts, np.int64))] if counts else np.empty(0, np.int64)
        return take(self.line_pool, self.line_start[at], sizes), np.diff(np.r_[0, ends])


def split_lines(text: str) -> list[str]:
    """Stretches between the line ends at which encoding falls apart into independent parts: those before a character
    that isn't white space. The line end itself is then a word of its own, whatever white space precedes it."""
    out: list[str] = []
    for k, part in enumerate(text.split("\n")):
        if k and (not part or part[0].isspace()):
            out[-1] += "\n" + part
        else:
            out.append(part)
    return out


_encoders: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per row of df: key and ids (array of int) of its text. Null and empty texts give an empty list; blank
    texts are encoded like any other; strings of special tokens are ordinary text; repeated rows repeat. Other columns
    are dropped, so clashing names don't matter. No shuffle, but for inputs of fewer partitions than cores."""
    merges = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary))
    kept = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary)
        if encoder is None:
            encoder = _encoders[vocabulary] = Encoder(merges.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, counts = encoder.encode(part.column(1).to_pylist())
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = kept.schema["_key"].dataType.simpleString()
    return spread(kept, "_key").mapInArrow(run, f"`{key}` {kind}, ids array<int>")
