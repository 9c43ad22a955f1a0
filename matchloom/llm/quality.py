"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Words are runs of one byte class (letters, digits, one punctuation mark), so
decoration such as ``!!`` or ``***`` is a word of its own.  Features are hashed
unigrams and bigrams of lower-cased words and uni-, bi- and trigrams of word
shapes; a document's vector is the mean of its features, and its score the
sparse dot product with the weights, through a sigmoid.  All of a whole text counts.

Training reads a bounded sample of labelled rows: the ``most`` rows of smallest
id hash.  Their features (never texts) go to one task, which answers with the weights.

Defined results: null and empty texts score by the bias alone; labels that
are null are left out, several labels of a document are averaged; no labels give
score 0.5 for every row; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as V

BITS = 18
MOST = 20_000
GAIN = 16.0

_CLASS = np.arange(256, dtype=np.int16) + 16  # each punctuation mark is its own class
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x80:] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature index) of every feature occurrence of the rows."""
    n = len(raw)
    kind = _CLASS[raw]
    begin = np.empty(n, dtype=bool)
    begin[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    cuts = offsets[1:-1]
    begin[cuts[cuts < n]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    word = kind[start] > 0
    start, end = start[word], end[word]
    low = V._LOWER[raw]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(V._BYTE[low] * V._pow("up", n)[:n], out=total[1:])
    h = V.mix64((total[end] - total[start]) * V._pow("down", n)[start]) if n else np.zeros(0, np.uint64)
    upper = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(_UPPER[raw], out=upper[1:])
    size = end - start
    caps = np.minimum(upper[end] - upper[start], 2) + (upper[end] - upper[start] == size) * 3
    k = kind[start].astype(np.int64)
    shape = V.mix64((k * 64 + caps * 8 + np.minimum(size, 7)).astype(np.uint64) + np.uint64(1 << 40))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    rows, found = [row, row], [h, shape]
    for x, m in ((h, 2), (shape, 2), (shape, 3)):
        if len(x) >= m:
            same = row[: len(row) - m + 1] == row[m - 1 :]
            rows.append(row[: len(row) - m + 1][same])
            found.append(V.ngrams(x, m)[same] + np.uint64(m))
    at = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(rows), at


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, raw, off in V.slices(b.column(0)):
            row, at = features(raw, off)
            key, count = np.unique(row << BITS | at, return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(j - i + 1))
            size = np.maximum(np.bincount(row, minlength=j - i), 1)
            value = (count / size[key >> BITS] * GAIN).astype(np.float32)
            index = (key & ((1 << BITS) - 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x)) for x in (index, value)]
            yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), *lists], ["y", "o", "at", "x"])


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates (L1 and L2)."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            at, x = b.column(2), b.column(3)
            for i in range(b.num_rows):
                rows.append((b.column(1)[i].as_py(), b.column(0)[i].as_py(), at[i].values.to_numpy(), x[i].values.to_numpy()))
        rows.sort(key=lambda r: r[0])
        model = Ftrl(1 << BITS)
        bias, one = np.array([1 << BITS], np.int32), np.ones(1, np.float32)
        rows = [(y, np.concatenate([at, bias]), np.concatenate([x, one])) for _, y, at, x in rows]  # 8 bytes a feature
        for _ in range(epochs if len(rows) else 0):
            for y, at, x in rows:
                model.update(at, x.astype(np.float64), y)
        w = model.weights(slice(None))
        hold = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(hold.astype(np.int32)), pa.array(w[hold])], ["at", "w"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, epochs: int = 4) -> np.ndarray:
    """Weights (2**BITS features, then the bias) from labels (doc_id, y in 0..1)."""
    chosen = labels.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows of 16 bytes: safe to broadcast
    told = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", F.xxhash64("doc_id").alias("o"))
    vectors = told.mapInArrow(_vectors, "y double, o long, at array<int>, x array<float>")
    got = vectors.repartition(1).mapInArrow(_train(epochs), "at int, w double").toPandas()  # at most 2**BITS + 1 rows
    w = np.zeros((1 << BITS) + 1)
    w[got["at"].to_numpy()] = got["w"].to_numpy()
    return w


def score_texts(column: pa.Array, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for i, j, raw, off in V.slices(column):
        row, at = features(raw, off)
        size = np.maximum(np.bincount(row, minlength=j - i), 1)
        out[i:j] = np.bincount(row, weights=w[at], minlength=j - i) / size * GAIN + w[-1]
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, w: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and score, which takes the place of a kept column of its name."""
    keep = [c for c in keep if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # 1 MB, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(b.column(0), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], [*keep, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, f"{fields}score double")


def fold(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))
