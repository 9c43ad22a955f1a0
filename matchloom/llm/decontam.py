"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased (A-Z) words.  Documents and benchmark items that share a
seed of ``shortest`` words are joined; a pair whose shared seeds could cover
``least`` of the item is tiled: the longest common run of unmarked words, found
by running Karp-Rabin hashes at falling lengths, is marked on both sides, again
and again, down to ``shortest`` words.  The item's share of marked words is its
coverage, however its passages are ordered in the document, and a document with
a coverage of ``least`` or more is contaminated.

The benchmark is taken in blocks of at most ``block_bytes`` of text; only one
block's word hashes are broadcast at a time and every document meets every
block, so neither side need be small.

Defined results: null and empty texts hold nothing; items without words are left out, and
items shorter than ``shortest`` words must occur whole; repeated items count once each; items without an id contaminate too and
stand as one null at the end of ``items``; every row has its own findings, with or without an id and
however many rows share it; an empty benchmark contaminates nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

SHORTEST, LEAST = 5, 0.8


def _runs(h: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of s unmarked words, and where they start."""
    total = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(total[s:] == total[: len(total) - s]) if len(h) >= s else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), at
    up = V._powers(V._BASE, len(h))
    roll = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return V.mix64((roll[at + s] - roll[at]) * V._powers(V._INV, len(h))[at]), at


def tile(item: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, length) of two arrays of word hashes."""
    shortest = min(shortest, len(item))
    fi, fd = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))

    def shared(s: int) -> tuple[np.ndarray, ...]:
        hi, ai = _runs(item, fi, s)
        hd, ad = _runs(doc, fd, s)
        keep = np.isin(hd, hi)
        return hi, ai, hd[keep], ad[keep]

    while most >= shortest > 0:
        lo, hi, found = shortest, most, None
        while lo <= hi:  # the longest length with a common run: if s words match, so do s - 1
            mid = (lo + hi + 1) // 2 if found is None or lo < hi else lo
            got = shared(mid)
            if len(got[2]):
                found, lo = (mid, got), mid + 1
            else:
                hi = mid - 1
        if found is None:
            break
        s, (hi_, ai, hd, ad) = found
        where: dict[int, list[int]] = {}
        for x, p in zip(hd.tolist(), ad.tolist(), strict=True):
            where.setdefault(x, []).append(p)
        for x in where:
            where[x].reverse()
        for x, p in zip(hi_.tolist(), ai.tolist(), strict=True):
            if not fi[p : p + s].all():
                continue
            spots = where.get(x, [])
            while spots and not fd[spots[-1] : spots[-1] + s].all():
                spots.pop()
            if spots:
                q = spots.pop()
                fi[p : p + s] = False
                fd[q : q + s] = False
                tiles.append((p, q, s))
        most = s
        if not shared(s)[2].size:
            most = s - 1
    return tiles


class Index:
    """Items of one block: their word hashes and a sorted table of seeds."""

    def __init__(self, ids: list[int | None], texts: list[str], shortest: int = SHORTEST):
        self.ids, self.items, self.shortest = [], [], shortest
        col = pa.array(texts, pa.large_string())
        for i, j, raw, off in V.slices(col):
            w = V.words(raw, off, lower=True)
            for r in range(j - i):
                if w.first[r + 1] > w.first[r]:
                    self.ids.append(ids[i + r])
                    self.items.append(w.hash[w.first[r] : w.first[r + 1]])
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for n, x in enumerate(self.items):
            by.setdefault(min(shortest, len(x)), []).append(n)
        for k, ns in by.items():
            h = [V.ngrams(self.items[n], k) for n in ns]
            item = np.concatenate([np.full(len(x), n) for n, x in zip(ns, h, strict=True)])
            pos = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            o = np.argsort(h, kind="stable")
            self.seeds[k] = (h[o], item[o], pos[o])

    def hits(self, w: V.Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, item, item positions under shared seeds)."""
        for k, (h, item, pos) in self.seeds.items():
            g = V.ngrams(w.hash, k)
            lo = np.searchsorted(h, g)
            at = np.flatnonzero((h[np.minimum(lo, len(h) - 1)] == g) & V.whole(w, k))
            if not len(at):
                continue
            # a row needs each seed once
            pair = np.unique(np.stack([w.row[at], lo[at]], axis=1), axis=0)
            n = np.searchsorted(h, h[pair[:, 1]], "right") - pair[:, 1]
            row = np.repeat(pair[:, 0], n)
            idx = np.repeat(pair[:, 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = row * len(self.items) + item[idx]
            o = np.argsort(key, kind="stable")
            key, p = key[o], pos[idx][o]
            cut = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                covered = np.zeros(len(self.items[key[a] % len(self.items)]), bool)
                for d in range(k):
                    covered[p[a:b] + d] = True
                yield int(key[a] // len(self.items)), int(key[a] % len(self.items)), covered

    def find(self, w: V.Words, least: float) -> Iterator[tuple[int, int | None, float]]:
        """(row, item id, coverage) of coverages of at least ``least``."""
        for row, n, covered in self.hits(w):
            item = self.items[n]
            need = least * len(item) - 1e-9
            if covered.sum() < need:
                continue
            done = sum(t[2] for t in tile(item, w.hash[w.first[row] : w.first[row + 1]], self.shortest))
            if done >= need:
                yield row, self.ids[n], done / len(item)


def scan(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, least: float = LEAST, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of docs, then items (array of contaminating item ids) and coverage (the largest, 0 if none).

    Columns of docs by those two names give way to the results.
    """
    spark = docs.sparkSession
    docs = docs.drop("items", "coverage")
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    keep = docs.columns

    def one(block: int, source: DataFrame) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about block_bytes
        index = spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], shortest))
        names = source.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = names.index("text")
            for b in batches:
                found: dict[int, list[tuple[int | None, float]]] = {}
                for i, _, raw, off in V.slices(b.column(at)):
                    w = V.words(raw, off, lower=True)
                    for row, item, share in index.value.find(w, least):
                        found.setdefault(i + row, []).append((item, share))
                lists = pa.array([sorted({x for x, _ in found.get(i, [])}, key=lambda x: (x is None, x)) for i in range(b.num_rows)], pa.list_(pa.int64()))
                most = pa.array([max((s for _, s in found.get(i, [])), default=0.0) for i in range(b.num_rows)], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, lists, most], [*names, "items", "coverage"])

        f = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in source.schema)
        return source.mapInArrow(run, f"{f}, items array<long>, coverage double")

    if blocks == 1:
        return one(0, docs)
    # Findings depend on the text alone; they join back by id and text, so a row gets what it would get from one block.
    key = F.sha2("text", 256)
    found = None
    for block in range(blocks):
        part = one(block, docs.select("doc_id", "text")).filter("coverage > 0").select("doc_id", key.alias("_key"), "items", "coverage").distinct()
        found = part if found is None else found.union(part)
    found = found.groupBy("doc_id", "_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("coverage").alias("coverage"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.sha2("d.text", 256) == F.col("f._key"))
    joined = docs.alias("d").join(found.alias("f"), same, "left")
    return joined.select(*(F.col(f"d.`{c}`") for c in keep), F.coalesce("f.items", F.array().cast("array<long>")).alias("items"), F.coalesce("f.coverage", F.lit(0.0)).alias("coverage"))
