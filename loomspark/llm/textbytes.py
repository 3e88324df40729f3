"""Vectorised views of string batches: bytes, words, shingle hashes.

A word is a maximal run of bytes other than space and U+0009..U+000D, as in ``[^\\x20\\x09-\\x0D]+``.
All hashes are 64-bit and depend on content only, so every executor computes the same ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text worked on at once; temporaries take some tens of bytes for each.
SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32



def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers otherwise keep what their largest task took.

    Large arrays get mappings of their own (glibc's M_MMAP_THRESHOLD); other C libraries are left alone.
    """
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 1 << 20)
        libc.malloc_trim(0)


_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, m, m^2, ... modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        grown = np.full(size, _MUL, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return whole[:0], np.zeros(1, np.int64)
    return whole[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES, texts: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes, at most ``texts`` each: (first, last, bytes, offsets)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + texts)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text): words never cross texts. The last has len(offsets) items."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    pos = np.arange(int(start[0]), int(end[-1]), dtype=np.int64)
    span = np.diff(np.append(start, end[-1]))
    pos -= np.repeat(start, span)
    seg = data[start[0] : end[-1]]
    value = (seg.astype(np.uint64) + np.uint64(1)) * powers(int(span.max()))[pos]
    value[IS_SPACE[seg]] = 0
    return mix64(np.add.reduceat(value, start - start[0]) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, word index) of each k-word shingle; a text of 1..k-1 words is one shingle."""
    start, end, first = words(data, offsets)
    w = word_hashes(data, start, end)
    count = np.diff(first)
    if not len(w):
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    factor = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n_full = np.maximum(count - k + 1, 0)
    h = np.zeros(len(w), np.uint64)
    for i in range(k):
        h[: len(w) - i] += w[i:] * factor[i]
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(w)) - np.repeat(first[:-1], count)
    full = at < np.repeat(n_full, count)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        for d in short:
            own = w[first[d] : first[d] + count[d]]
            h[first[d]] = (own * factor[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        full[first[:-1][short]] = True
    return mix64(h[full]), doc[full], at[full]
