"""Vectorised text kernels: words, word hashes and n-gram hashes of whole Arrow batches.

Words are maximal runs of bytes other than space and \\x09-\\x0D, as in the
pattern ``[^\\x20\\x09-\\x0D]+``; UTF-8 multi-byte characters never contain such
bytes, so splitting bytes equals splitting code points.  Work is done on slices
of about ``CHUNK`` bytes that end at row boundaries, so memory is bounded by the
slice (or by one longest text), never by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _pow(which: str, n: int) -> np.ndarray:
    if which not in _cache or len(_cache[which]) < n:
        made = _powers(_BASE if which == "up" else _INV, max(n, CHUNK + 4096))
        if n > 8 * CHUNK:  # one very long text: do not keep tables of its size
            return made
        _cache[which] = made
    return _cache[which]


def trim() -> None:
    """Gives freed memory back to the system: Python workers are reused and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


@dataclass
class Words:
    """Words of some rows: byte offsets in ``data``, hash, and the row of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first[i]: number of words before row i; length rows + 1
    hash: np.ndarray | None

    @property
    def n(self) -> int:
        return len(self.start)


def slices(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, bytes, offsets from 0) of slices of about ``size`` (CHUNK) bytes.

    Null texts have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (size or CHUNK), "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words of the rows that ``offsets`` cuts ``raw`` into."""
    if lower:
        raw = _LOWER[raw]
    n = len(raw)
    solid = np.empty(n + 1, dtype=bool)
    np.logical_not(_SPACE[raw], out=solid[:n])
    solid[n] = False
    begin = solid[:n].copy()
    begin[1:] &= ~solid[: n - 1] if n else solid[:0]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] = solid[cuts]
    start = np.flatnonzero(begin)
    stop = np.empty(n + 1, dtype=bool)  # stop[i]: byte i - 1 is the last of a word
    stop[0] = False
    np.logical_and(solid[:n], ~solid[1:], out=stop[1:])
    if len(cuts):
        stop[cuts] |= solid[cuts - 1] & (cuts > 0)
    end = np.flatnonzero(stop)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = None
    if hashed:
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * _pow("up", n)[:n], out=total[1:])
        h = mix64((total[end] - total[start]) * _pow("down", n)[start] if n else np.zeros(0, np.uint64))
    return Words(raw, start, end, row, first, h)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; shorter than k: none. Rows are not told apart."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += h[j : j + n]
    return mix64(out)


def whole(w: Words, k: int) -> np.ndarray:
    """Which of the k-grams of ``ngrams`` lie within one row."""
    if w.n < k:
        return np.zeros(0, dtype=bool)
    return w.row[: w.n - k + 1] == w.row[k - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in linear time by blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
