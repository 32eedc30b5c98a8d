"""Vectorised text primitives over Arrow string buffers.

A block is a run of documents as one byte array with offsets, so that splitting, hashing and
windowing cost a few array operations per block, whatever the number of documents in it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most bytes of text in a block (a longer document is a block by itself). Bounds memory.
BLOCK_BYTES = 512 << 10

U64 = np.uint64

# Arrow's own allocator keeps what is freed; the system's gives it back (give_back), which workers that stages share need
pa.set_memory_pool(pa.system_memory_pool())


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
    return mix(z)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = _splitmix(256, 17)
_BASE = int(_splitmix(1, 99)[0]) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but 0-9, a-z and non-ASCII bytes; A-Z counts as a letter once lowered.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def string_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


#: Most documents in a block, so that a document's place fits in 12 bits of a sort key.
BLOCK_ROWS = 4096


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batch with at most `most` bytes of text and BLOCK_ROWS rows: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    data, offsets = string_block(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + BLOCK_ROWS, batch.num_rows)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    del data, offsets
    give_back()


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Freed memory goes back to the system: workers are used again by other stages, and would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words:
    """Words of a block: starts, ends (byte positions) and first[d]..first[d+1], the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        inside = ~separators[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge] = inside[edge]
        finish[edge - 1] = inside[edge - 1]
        self.data = data
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes by prefix sums, then mixed with its length."""
        up, down = _power(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, alike for equal bytes."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] at each i; the last width-1 entries wrap and mean nothing."""
    out = np.zeros(len(h), U64)
    for k in range(width):
        out = out * U64(0x9FB21C651E98DF25) + (np.roll(h, -k) if k else h)
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Which words begin a window of `width` words that lies in one document."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= width


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]] for each d, which depend on these values alone."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros(len(first) - 1, kind)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: first[-1]], first[some], dtype=kind)
    return out
