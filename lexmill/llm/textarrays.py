"""Texts as flat arrays of code points, with hashes over them; shared by the operators on word and character windows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
CHAR_BASE, WORD_BASE = U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(U) + ODD
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


@cache
def kinds() -> np.ndarray:
    """By code point: 1 letter (category L), 2 number (category N), 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            out[c] = 1 if k == "L" else 2
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def batches_of_texts(texts: list[str | None], most: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, row of each stretch, start in the flat array, offset of the stretch in its text), of at most `most`
    code points at once; a longer text comes in several stretches that share `overlap` code points."""
    parts: list[str] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return code_points("".join(parts)), np.array(rows, np.int64), np.r_[0, np.cumsum(lengths)], np.array(offsets, np.int64)

    for row, text in enumerate(texts):
        if not text:
            continue
        step = max(1, most - overlap)
        for at in range(0, max(1, len(text) - overlap), step):
            piece = text if len(text) <= most else text[at : at + most]
            if size and size + len(piece) > most:
                yield flush()
                parts, rows, offsets, size = [], [], [], 0
            parts.append(piece)
            rows.append(row)
            offsets.append(at)
            size += len(piece)
            if len(text) <= most:
                break
    if parts:
        yield flush()


def window_hashes(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each `width` consecutive values, by doubling; one per start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        now, power, size = values.astype(U), base, 1
        done: np.ndarray | None = None
        at, rest = 0, width
        while True:
            if rest & size:
                part = now[at : at + n]
                done = part.copy() if done is None else done * power + part
                at += size
                rest -= size
            if not rest:
                return mix(done)
            now = now[:-size] * power + now[size:]
            power = U((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
            size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    size, now = 1, values
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def word_edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each code point, and start and end of each maximal run of letters or digits."""
    kind = kinds()[points]
    edge = np.diff(np.r_[False, kind > 0, False].astype(np.int8))
    return kind, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_arrays(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of each maximal run of letters or digits, and whether the run holds digits only."""
    kind, start, end = word_edges(points)
    if not len(start):
        return start, np.empty(0, U), np.empty(0, bool)
    at = np.flatnonzero(kind > 0)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        hashed = np.add.reduceat(mix(points[at].astype(U) | (place.astype(U) << U(21))), first)
    return start, hashed, np.minimum.reduceat(kind[at], first) == 2
