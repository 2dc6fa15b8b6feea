"""Whole batches of texts as arrays: words, lines and their hashes, without a Python loop per word.

Used inside Arrow tasks. A batch is cut into slices of half a megabyte, always of whole texts, so
memory follows the slice and the longest text. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word after lower-casing: digits, a-z and all of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: All but white space.
INK = np.ones(256, dtype=bool)
INK[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, a longer text alone."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def _grown(table: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    if len(table) > size:
        return table
    steps = np.full(max(size + 1, SLICE_BYTES + 1), base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Runs:
    """Runs of bytes that satisfy ``kind``, within texts: row, start and end of each."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.base = int(bounds[0])
        self.rows = len(bounds) - 1
        self.bounds = bounds - self.base
        data = raw[self.base : int(bounds[-1])]
        self.data = LOWER[data] if lower else data
        inside = kind[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.bounds] = True
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the data."""
    global _powers, _inverses
    _powers = _grown(_powers, _BASE, len(data))
    _inverses = _grown(_inverses, _BASE_INVERSE, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=sums[1:])
    spans = (sums[end] - sums[start]) * _inverses[start]
    return mix(spans + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: Runs, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each run of ``size`` words; a shorter text is one shingle."""
    hashes, total = words.hashes(), len(words.start)
    if total >= size:
        acc = np.zeros(total - size + 1, dtype=np.uint64)
        for j in range(size):
            acc = acc * np.uint64(0xFF51AFD7ED558CCD) + hashes[j : total - size + 1 + j]
        acc = mix(acc)
        whole = words.row[: total - size + 1] == words.row[size - 1 :]
        at = np.flatnonzero(whole)
        acc, row = acc[at], words.row[at]
    else:
        at, row, acc = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size):
            index = np.minimum(words.first[short] + j, total - 1)
            word = np.where(j < words.count[short], hashes[index], np.uint64(j + 1))
            extra = extra * np.uint64(0xFF51AFD7ED558CCD) + word
        extra = mix(extra ^ np.uint64(0xA0761D6478BD642F))
        order = np.argsort(np.concatenate((row, short)), kind="stable")
        acc = np.concatenate((acc, extra))[order]
        at = np.concatenate((at, words.first[short]))[order]
        row = np.concatenate((row, short))[order]
    return acc, row, at
