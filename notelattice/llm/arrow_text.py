"""Columnar text primitives shared by the operators: every function works on a whole Arrow slice with numpy.

A *chunk* is a run of rows whose text is at most a few hundred kilobytes (one longer row makes a chunk of its own),
so that working arrays stay small whatever the batch size. Words are maximal runs of bytes other than 0x20 and
0x09-0x0D; in UTF-8 those bytes never occur inside a longer character, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte, and the base of the polynomial with its inverse modulo 2**64.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32



def release() -> None:
    """Gives what a task has freed back to the system: Python workers are reused, and would keep each stage's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor, shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of values (uint64 per position): equal spans get equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(U64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * U64(0xD6E8FEB86659FD93))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty ranges give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    sums = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=sums[1:], dtype=kind)
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Chunk:
    """Consecutive rows of a batch: data holds their UTF-8 bytes one after another, row i is data[off[i]:off[i + 1]]."""

    __slots__ = ("data", "null", "off", "start", "stop")

    def __init__(self, data: np.ndarray, off: np.ndarray, null: np.ndarray, start: int, stop: int):
        self.data, self.off, self.null, self.start, self.stop = data, off, null, start, stop

    def __len__(self) -> int:
        return self.stop - self.start

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the offsets of each row's words among them."""
        data = self.data if data is None else data
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        word = IS_WORD[data]
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        edges = self.off[self.off < len(data)]
        before[edges] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.off)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column in chunks; null texts count as empty and are marked."""
    column = strings(column)
    null = np.asarray(column.is_null())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        stop = min(stop, n, start + (1 << 16))
        part = off[start : stop + 1]
        yield Chunk(data[part[0] : part[-1]], part - part[0], null[start:stop], start, stop)
        start = stop


def word_hashes(chunk: Chunk, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z folded if asked for, and the offsets of each row's words."""
    starts, ends, off = chunk.words()
    data = LOWER[chunk.data] if lower else chunk.data
    return span_hashes(BYTE_VALUE[data], starts, ends), off


def shingle_hashes(words: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words within a row, and their offsets by row. A shorter row that has words is one run."""
    counts = np.diff(off)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_off = np.zeros(len(off), np.int64)
    np.cumsum(n, out=out_off[1:])
    factors = [U64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(size)]
    total = len(words)
    full = np.zeros(total, U64)
    for k, factor in enumerate(factors):
        if total > k:
            full[: total - k] += words[k:] * factor
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(out_off[-1]) - out_off[row] + off[row]
    out = full[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:  # a row with fewer words: the whole sequence, told apart by its length
        value = 0
        for k, w in enumerate(words[off[i] : off[i + 1]]):
            value += int(w) * int(factors[k])
        out[out_off[i]] = U64((value + int(counts[i]) * 0xA0761D6478BD642F) % (1 << 64))
    return mix(out), out_off


def repeated_in_row(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the entries that occur twice or more in their row, and of those that follow an equal one."""
    row = np.repeat(np.arange(len(off) - 1, dtype=U64), np.diff(off))
    keys = hashes ^ mix(row + U64(1))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later
