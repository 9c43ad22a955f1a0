"""Substring dedup of word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document; a word goes if a window
that covers it also starts in a document with a smaller id.  Consecutive
windows that share a minimiser (the least hash of the ``m``-word grams in them)
form a super-k-mer and travel as one packed string to the minimiser's bucket.

1. One pass over the texts gives the super-k-mers as numbers: place, length,
   minimiser, hash.  Equal windows have equal minimisers, so minimisers that
   occur in one document only are dropped here, which drops most of a corpus.
2. The texts of what is left are packed: each super-k-mer's words, once, with
   its bucket.  Minimisers with more than ``hot`` different super-k-mers are
   split: their windows travel singly, to a bucket of the window's own hash, where
   only equal ones meet.
3. Equal strings are aggregated to one (smallest and largest document) before they go to
   their bucket, where they arrive sorted; if there are several, their windows are sorted as
   strings and counted exactly.  A bucket holds at most ``hot`` different strings.
4. What each super-k-mer repeats goes back to its occurrences by
   (bucket, hash), a join whose hot side Spark can split, then by document to
   the texts, where the kept words are read off.

Defined results: null texts have no words; windows do not cross documents;
texts below k words keep all; rows with a null doc_id take no part and keep all
their words; rows that share a doc_id are one document with several texts: they
do not repeat each other; identical rows get identical results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stash as S
from . import vectext as V

K, M = 50, 8
LONGEST = 48  # windows of a super-k-mer: first and last window cover all its words


def _window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows by a prefix sum."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * V._pow("up", n)[:n])])
    return V.mix64((total[k:] - total[: n - k + 1]) * V._pow("down", n)[: n - k + 1])


def _identity(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    return V.mix64(first + V.mix64(last + n.astype(np.uint64)) * V._BASE)


def superkmers(w: V.Words, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(row, place in the row, windows, minimiser, hash) of all super-k-mers, and the window hashes."""
    full = V.whole(w, k)
    if not full.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64), z.view(np.uint64)
    least = V.sliding_min(V.ngrams(w.hash, m), k - m + 1)
    win = _window_hash(w.hash, k)
    at = np.flatnonzero(full)
    row, value = w.row[at], least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    if (size > LONGEST).any():  # cut long runs into pieces
        pieces = -(-size // LONGEST)
        base = np.repeat(head, pieces)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = base + step * LONGEST
        size = np.diff(np.append(head, len(at)))
    first = at[head]
    return row[head], first - w.first[row[head]], size, value[head], _identity(win[first], win[first + size - 1], size), win


def _numbers(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, raw, off in V.slices(b.column(0)):
                row, pos, size, mini, ident, _ = superkmers(V.words(raw, off), k, m)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(V.signed(mini)), pa.array(V.signed(ident))], ["doc_id", "version", "pos", "size", "mini", "ident"])

    return run


def _pack(k: int):
    """Texts with their segments (pos, size, mini, hot) to packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs = b.column(3)
            for i, j, raw, off in V.slices(b.column(0)):
                w = V.words(raw, off)
                win = _window_hash(w.hash, k)
                mine = segs.slice(i, j - i)
                count = np.asarray(mine.value_lengths().fill_null(0), dtype=np.int64)
                flat = mine.flatten()
                pos, size, mini, hot = (np.asarray(flat.field(f)) for f in range(4))
                row = np.repeat(np.arange(j - i), count)
                # hot segments are unfolded to single windows
                reps = np.where(hot, size, 1)
                step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                row, pos, single = np.repeat(row, reps), np.repeat(pos, reps) + step, np.repeat(hot, reps)
                size = np.where(single, 1, np.repeat(size, reps)).astype(np.int64)
                first = w.first[row] + pos
                last = first + size - 1
                ident = _identity(win[first], win[last], size)
                bucket = np.where(single, V.signed(V.mix64(win[first] + np.uint64(77))), np.repeat(mini, reps))
                a, z = w.start[first].tolist(), w.end[last + k - 1].tolist()
                sole = np.flatnonzero(np.diff(w.start) - (w.end[:-1] - w.start[:-1]) != 1) if w.n > 1 else np.zeros(0, int)
                odd = np.searchsorted(sole, first) != np.searchsorted(sole, last + k - 1)
                body = raw.tobytes()
                strings = [b" ".join(body[x:y].split()) if o else body[x:y].translate(_BLANK) for x, y, o in zip(a, z, odd.tolist(), strict=True)]
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(bucket.astype(np.int64)), pa.array(V.signed(ident)), pa.array(strings, pa.binary())], ["doc_id", "version", "pos", "size", "bucket", "ident", "packed"])

    return run


_BLANK = bytes(0x20 if i in range(0x09, 0x0E) else i for i in range(256))


def _count(k: int):
    """Sorted buckets to (bucket, ident, runs): runs of windows (offset, n) and the smallest document that has them."""
    kind = pa.list_(pa.struct([("off", pa.int32()), ("n", pa.int32()), ("doc", pa.int64())]))

    def solve(strings: list[tuple[bytes, int, int, int]]) -> list[tuple[int, list]]:
        if len(strings) == 1:
            s, ident, lo, hi = strings[0]
            return [(ident, [(0, s.count(b" ") + 2 - k, lo)])] if lo < hi else []
        windows = []
        for n, (s, _, _, _) in enumerate(strings):
            cut = [-1, *(i for i, c in enumerate(s) if c == 0x20), len(s)]
            windows += [(s[cut[i] + 1 : cut[i + k]], n, i) for i in range(len(cut) - k)]
        windows.sort()
        least: list[list[int]] = [[0] * (s.count(b" ") + 2 - k) for s, _, _, _ in strings]
        i = 0
        while i < len(windows):
            j = i
            while j < len(windows) and windows[j][0] == windows[i][0]:
                j += 1
            lo = min(strings[windows[x][1]][2] for x in range(i, j))
            for x in range(i, j):
                least[windows[x][1]][windows[x][2]] = lo
            i = j
        out = []
        for (_, ident, _, hi), mins in zip(strings, least, strict=True):
            runs: list[list[int]] = []
            for off, lo in enumerate(mins):
                if lo < hi:
                    if runs and runs[-1][2] == lo and runs[-1][0] + runs[-1][1] == off:
                        runs[-1][1] += 1
                    else:
                        runs.append([off, 1, lo])
            if runs:
                out.append((ident, [tuple(r) for r in runs]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, ready = None, [], []

        def out():
            made = pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in ready], pa.int64()), pa.array([x[1] for x in ready], pa.int64()), pa.array([[dict(zip(("off", "n", "doc"), r, strict=True)) for r in x[2]] for x in ready], kind)],
                ["bucket", "ident", "runs"],
            )
            ready.clear()
            return made

        for b in batches:
            for bk, ident, s, lo, hi in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if bk != bucket:
                    ready += [(bucket, i, r) for i, r in solve(held)] if held else []
                    bucket, held = bk, []
                if held and held[-1][0] == s:
                    held[-1] = (s, ident, min(lo, held[-1][2]), max(hi, held[-1][3]))
                else:
                    held.append((s, ident, lo, hi))
                if len(ready) > 20_000:
                    yield out()
        ready += [(bucket, i, r) for i, r in solve(held)] if held else []
        if ready:
            yield out()

    return run


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with word intervals to remove (from, to) to counts and the kept words."""
    for b in batches:
        spans = b.column(2)
        for i, j, raw, off in V.slices(b.column(0)):
            w = V.words(raw, off, hashed=False)
            body = raw.tobytes()
            n_removed, kept = [], []
            for r in range(j - i):
                a, z = w.first[r], w.first[r + 1]
                cut = spans[i + r].values
                if cut is None or not len(cut):
                    n_removed.append(0)
                    kept.append(b" ".join(body[off[r] : off[r + 1]].split()))
                    continue
                edge = np.zeros(z - a + 1, dtype=np.int64)
                np.add.at(edge, np.asarray(cut.field(0)), 1)
                np.add.at(edge, np.asarray(cut.field(1)), -1)
                keep = np.cumsum(edge)[:-1] == 0
                n_removed.append(int((~keep).sum()))
                s, e = w.start[a:z][keep].tolist(), w.end[a:z][keep].tolist()
                kept.append(b" ".join([body[x:y] for x, y in zip(s, e, strict=True)]))
            n_words = pa.array(np.diff(w.first).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), n_words, pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, k: int = K, m: int = M, hot: int = 512) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", F.xxhash64("text").alias("version"))
    some = texts.filter("doc_id IS NOT NULL")
    numbers = S.stash(some.mapInArrow(_numbers(k, m), "doc_id long, version long, pos int, size int, mini long, ident long"), "superkmers")
    kinds = numbers.groupBy("mini", "ident").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    minis = kinds.groupBy("mini").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    # stashed, so that both sides of the join are plain exchanges and Spark can split a hot minimiser
    minis = S.stash(minis.select("mini", (F.col("n") > hot).alias("hot")), "minimisers")
    shared = numbers.join(minis, "mini")
    segs = S.stash(shared.groupBy("doc_id", "version").agg(F.collect_set(F.struct("pos", "size", "mini", "hot")).alias("segs")), "segments")
    S.drop(numbers, minis)

    packed = some.join(segs, ["doc_id", "version"]).select("text", "doc_id", "version", "segs")
    packed = S.stash(packed.mapInArrow(_pack(k), "doc_id long, version long, pos int, size int, bucket long, ident long, packed binary"), "packed")
    S.drop(segs)

    # copies are one row before they meet in a bucket, however many there are
    strings = packed.groupBy("bucket", "ident", "packed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    strings = strings.repartition("bucket").sortWithinPartitions("bucket", "packed")
    counted = S.stash(strings.mapInArrow(_count(k), "bucket long, ident long, runs array<struct<off:int,n:int,doc:bigint>>"), "counted")
    places = packed.select("bucket", "ident", "doc_id", "version", "pos")
    again = F.filter("runs", lambda r: r["doc"] < F.col("doc_id"))
    span = lambda r: F.struct((F.col("pos") + r["off"]).alias("from"), (F.col("pos") + r["off"] + r["n"] + (k - 1)).alias("to"))
    spans = places.join(counted, ["bucket", "ident"]).select("doc_id", "version", F.transform(again, span).alias("spans")).filter("size(spans) > 0")
    spans = S.stash(spans.groupBy("doc_id", "version").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    S.drop(packed, counted)
    out = texts.join(spans, ["doc_id", "version"], "left").select("text", "doc_id", "spans")
    return out.mapInArrow(_cut_words, "doc_id long, n_words long, n_removed long, kept string")
