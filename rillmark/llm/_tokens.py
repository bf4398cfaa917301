"""Words of a batch of texts as numpy arrays, without a Python object for each word.

All byte classes used here are ASCII, so they can be read off the UTF-8 bytes: a byte of 0x80 or more always belongs to a
word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier, its inverse modulo 2^64, and the two multipliers of the 64-bit finaliser.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(pattern_bytes: list[int]) -> np.ndarray:
    """A table that is True for the bytes that separate words."""
    table = np.zeros(256, dtype=bool)
    table[pattern_bytes] = True
    return table


#: Space and the controls from tab to carriage return.
SPACES = byte_class([0x20, *range(0x09, 0x0E)])
#: All ASCII but digits and a-z (after lower-casing).
NOT_ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX_2)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of each (one more than there are texts). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, columns: list[str], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of about limit bytes of text, so that the arrays made from a piece stay small; a longer text is a piece of its own."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for name in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = upto[at - 1] if at else 0
        stop = max(int(np.searchsorted(upto, base + limit, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


class Words:
    """The words of a batch: start and end in the bytes, 64-bit hash, and where each document's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data = LOWER[raw]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = ~separators[self.data]
        # A document's first byte starts a word whatever the byte before it is.
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge))
        self.end = np.flatnonzero(before & (~inside | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        step = 1 << 20  # bytes at a time, so that the powers stay in the cache
        w = 0
        while w < len(self.start):
            lo = self.start[w]
            stop = max(int(np.searchsorted(self.end, lo + step, side="right")), w + 1)
            hi = self.end[stop - 1]
            up, down = _powers(int(hi - lo))
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            out[w:stop] = (sums[self.end[w:stop] - lo] - sums[self.start[w:stop] - lo]) * down[self.start[w:stop] - lo]
            w = stop
        return mixed(out)

    def text(self, a: int, b: int) -> bytes:
        """The lower-case bytes from the start of word a to the end of word b."""
        return self.data[self.start[a] : self.end[b]].tobytes()


_kept: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_kept.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _kept[name] = np.multiply.accumulate(steps)
    return _kept["up"], _kept["down"]


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each document, repeats included, and where each document's begin.

    A document with fewer words, but not none, has one: all its words.
    """
    counts = np.diff(words.first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(made)])
    rolled = np.zeros(max(len(words.hash) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(_MIX_1) + words.hash[k : len(words.hash) - n + 1 + k]
    out = np.empty(first[-1], dtype=np.uint64)
    full = np.flatnonzero(counts >= n)
    if len(full):
        reach = made[full]
        at = np.repeat(words.first[full], reach) + _within(reach)
        out[np.repeat(first[full], reach) + _within(reach)] = mixed(rolled[at])
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        value = np.uint64(counts[d])
        for h in words.hash[words.first[d] : words.first[d + 1]]:
            value = np.uint64((int(value) * _MIX_2 + int(h)) & 0xFFFFFFFFFFFFFFFF)
        out[first[d]] = mixed(np.array([value]))[0]
    return out, first


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
