"""Codes of vectors by a product quantiser that is trained and applied in whole numbers.

Components become ``floor(scale * x)`` and vectors are cut into ``parts`` equal consecutive parts.  Each part position
has a codebook of ``entries`` entries, at first that part of the vectors of smallest id.  A round assigns each part to its nearest entry
(squared distance, ties to the lower index) and replaces entries by ``floor(sum / count)`` of their parts, component by component; an entry without
parts stays.  Tasks emit sums and counts by (part, entry), so the driver receives numbers of the size of the codebooks only.

The nearest entry is found in a vantage-point tree for each part position: a node holds an entry and, for what lies inside and
outside of the median distance from it, the least and the largest distance, rounded down and up.  By the triangle inequality a side
is at least ``d - largest`` and ``least - d`` away from a query at distance d of the entry, with d rounded up or down against us; a side is left out only if that is strictly more than the
best distance so far, so ties are met too, and every entry that is met is compared by its whole squared distance.  A batch of
queries goes down the tree together, nearer side first.

Defined results: rows whose vector is null or holds null or non-finite components are left out; other vectors count
from the first component, shorter ones padded with zeros to a multiple of ``parts`` that holds the longest; a null id comes after all others;
equal ids are told apart by their components; fewer rows than ``entries`` give fewer entries; components whose squared distances could pass
64 bits are an error before any work; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stash as S

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 4
BROADCAST_ROWS = 100_000


def _floor(x: np.ndarray) -> np.ndarray:
    """At most the root of whole numbers below 2**63."""
    return np.maximum(np.floor(np.sqrt(x.astype(np.float64))) - 1, 0).astype(np.int64)


def _ceil(x: np.ndarray) -> np.ndarray:
    """At least the root of whole numbers below 2**63."""
    return np.ceil(np.sqrt(x.astype(np.float64))).astype(np.int64) + 1


def squared(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    return ((x - e) ** 2).sum(axis=-1)


class Tree:
    """A vantage-point tree over the entries of one part position."""

    def __init__(self, book: np.ndarray, at: np.ndarray | None = None):
        at = np.arange(len(book)) if at is None else at
        self.at, self.entry, self.sides = at, book[at], []
        if len(at) <= LEAF:
            return
        d = squared(self.entry[1:], self.entry[0])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        self.middle = int(d[order[half]])
        for side in (order[:half], order[half:]):
            least, largest = int(_floor(d[side].min())), int(_ceil(d[side].max()))
            self.sides.append((least, largest, Tree(book, at[1 + np.sort(side)])))
        self.at, self.entry = at[:1], self.entry[:1]

    def visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        """Betters ``best`` (squared distance) and ``which`` (entry) of these rows of x."""
        y = x[rows]
        for i, e in zip(self.at.tolist(), self.entry, strict=True):
            d = squared(y, e)
            better = (d < best[rows]) | ((d == best[rows]) & (i < which[rows]))
            hit = rows[better]
            best[hit], which[hit] = d[better], i
        if not self.sides:
            return
        low, high, inside = _floor(d), _ceil(d), d < self.middle
        for near, far, mine in ((0, 1, inside), (1, 0, ~inside)):
            if not mine.any():
                continue
            r, lo, hi = rows[mine], low[mine], high[mine]
            for least, largest, side in (self.sides[near], self.sides[far]):
                away = np.maximum(np.maximum(lo - largest, least - hi), 0)
                open_ = away * away <= best[r]
                if open_.any():
                    side.visit(x, r[open_], best, which)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x."""
        best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        if len(x):
            self.visit(x, np.arange(len(x)), best, which)
        return which, best


@dataclass
class Books:
    """Codebooks: whole numbers by part, entry, position."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree(b) for b in self.entries]

    def assign(self, x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances) of all parts of rows of whole numbers."""
        p, _, w = self.entries.shape
        found = [t.nearest(np.ascontiguousarray(x[:, i * w : (i + 1) * w])) for i, t in enumerate(trees)]
        return tuple(np.stack(z, axis=1) if p else np.zeros((len(x), 0), np.int64) for z in zip(*found, strict=True))


def _sound(column: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, lengths, scaled components one after another); with ``dim`` as a matrix of whole numbers."""
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    value = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    end = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    ok = np.asarray(column.is_valid()) & (bad[end] == bad[end - size])
    rows = np.flatnonzero(ok)
    with np.errstate(over="ignore"):
        flat = np.floor(value[np.repeat(ok, size)] * scale)
    if dim is None:
        return rows, size[rows], flat
    out = np.zeros((len(rows), dim), np.int64)
    out[np.arange(dim)[None, :] < size[rows][:, None]] = flat.astype(np.int64)
    return rows, size[rows], out


def _measure(vectors: DataFrame, scale: int) -> tuple[int, float]:
    """(longest vector, largest scaled component) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, largest = -1, 0.0
        for b in batches:
            _, size, flat = _sound(b.column(0), scale)
            longest, largest = max(longest, int(size.max(initial=-1))), max(largest, float(np.abs(flat).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([largest])], ["longest", "largest"])

    longest, largest = vectors.select("embedding").mapInArrow(run, "longest long, largest double").agg(F.max("longest"), F.max("largest")).collect()[0]
    return -1 if longest is None else longest, largest or 0.0


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks of vectors (vec_id, embedding); vectors are read ``rounds`` + 2 times, so it had better be a table."""
    longest, largest = _measure(vectors, scale)
    width = -(-max(longest, 0) // parts)
    dim = width * parts
    if dim * (2 * largest) ** 2 >= 2**63:
        raise ValueError(f"components up to {largest / scale:g} are too large: squared distances could pass 64 bits")
    if longest < 0:
        return Books(np.zeros((parts, 0, 0), np.int64), scale)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, _, x = _sound(b.column(1), scale, dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), max(dim, 1)).cast(pa.list_(pa.int64())) if dim else pa.array([[]] * len(rows), pa.list_(pa.int64()))], ["vec_id", "x"])

    first = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(smallest, "vec_id long, x array<long>").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    book = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        book = _round(vectors, Books(book, scale))
    return Books(book, scale)


def _round(vectors: DataFrame, books: Books) -> np.ndarray:
    """The next entries: sums and counts of all parts by entry."""
    p, k, w = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, total = books.trees(), np.zeros((p, k, w + 1), np.int64)
        for b in batches:
            x = _sound(b.column(0), books.scale, books.dim)[2]
            which, _ = books.assign(x, trees)
            for i in range(p):
                np.add.at(total[i], which[:, i], np.concatenate([np.ones((len(x), 1), np.int64), x[:, i * w : (i + 1) * w]], axis=1))
        part, entry, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)) for z in (part, entry, place)] + [pa.array(total[part, entry, place])], ["part", "entry", "place", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "part int, entry int, place int, n long")
    got = np.zeros((p, k, w + 1), object)
    for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # p * k * (w + 1) rows at most
        got[r["part"], r["entry"], r["place"]] = int(r["n"])
    out = books.entries.copy()
    used = got[:, :, 0] > 0
    if used.any():
        out[used] = (got[used][:, 1:] // got[used][:, :1]).astype(np.int64)
    return out


def encode(vectors: DataFrame, books: Books, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of vectors (embedding), code (a byte for each part), error (squared distance of all parts)."""
    keep = [c for c in keep if c not in ("code", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for b in batches:
            rows, _, x = _sound(b.column(0), books.scale, books.dim)
            if books.entries.shape[1] == 0:
                rows, x = rows[:0], x[:0]
            which, d = books.assign(x, trees)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(which.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(which.astype(np.uint8)))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in b.columns[1:]), code, pa.array(d.sum(axis=1))], [*keep, "code", "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.select(*keep).schema)
    return vectors.select(F.col("embedding").alias("_x"), *keep).mapInArrow(run, f"{fields}code binary, error long")


def decode(codes: DataFrame, books: Books, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of codes (code), embedding: the middle of what the entries stand for."""
    keep = [c for c in keep if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = books.entries.shape[0]
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, p)
            x = (books.entries[np.arange(p)[None, :], raw].reshape(len(raw), -1) + 0.5) / books.scale
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(x), pa.list_(pa.float64()))], [*keep, "embedding"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in codes.select(*keep).schema)
    return codes.filter("code IS NOT NULL").select(F.col("code").alias("_c"), *keep).mapInArrow(run, f"{fields}embedding array<double>")


def with_group_error(encoded: DataFrame, by: str, name: str) -> DataFrame:
    """encoded (a table) with the sum of ``error`` over equal ``by``, nulls together."""
    total = S.stash(encoded.groupBy(F.col(by).alias("_by")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias(name)), "errors")
    small = total.count() <= BROADCAST_ROWS
    return encoded.join(F.broadcast(total) if small else total, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
