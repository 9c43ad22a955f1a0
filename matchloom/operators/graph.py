"""Approximate search in layered graphs of neighbours, a graph for each shard of the gallery.

References are dealt to shards by a hash of their id; a kernel builds each shard's graph and stores it as arrays, so it is built
once for any number of queries. A node has a top level drawn from its id; on every level up to it, it is linked both ways with the near nodes that are
nearer to it than to a link already chosen. A search goes down from the entry node, greedily on the upper
levels, and on the lowest with a list of the ``ef`` best seen. Every query meets every shard; the shards' answers are merged by similarity, ties to the smaller id.

Everything is drawn from ids and built in their order, so the same gallery gives the same graphs.

Defined results: vectors that are null, hold null or non-finite components or have another length than most
take no part; repeated query rows are answered once for each row; an empty gallery answers no one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import _own, _sound

LINKS, EF_BUILD, EF = 16, 100, 64
SHARD_ROWS, QUERY_ROWS = 4096, 2000
INDEX = "shard int, dim int, ids binary, z binary, level binary, links binary, entry int"


def _draw(ids: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] of ids."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-53


class Graph:
    """Nodes in the order of their ids; links[level][node] are the linked nodes, -1 where there are fewer."""

    def __init__(self, ids: np.ndarray, z: np.ndarray, level: np.ndarray, links: list[np.ndarray], entry: int):
        self.ids, self.z, self.level, self.links, self.entry = ids, z, level, links, entry

    @staticmethod
    def build(ids: np.ndarray, z: np.ndarray, m: int = LINKS, ef: int = EF_BUILD) -> Graph:
        order = np.argsort(ids, kind="stable")
        ids, z = ids[order], np.ascontiguousarray(z[order])
        level = np.floor(-np.log(_draw(ids)) / math.log(m)).astype(np.int64)
        tops = int(level.max(initial=0))
        links = [np.full((len(ids), 2 * m if i == 0 else m), -1, np.int32) for i in range(tops + 1)]
        g = Graph(ids, z, level, links, 0)
        for node in range(1, len(ids)):
            g._insert(node, ef)
        return g

    def _insert(self, node: int, ef: int) -> None:
        q, at, top = self.z[node], self.entry, int(self.level[self.entry])
        for i in range(top, int(self.level[node]), -1):
            at = self._climb(q, at, i)
        near = [(float(self.z[at] @ q), at)]
        for i in range(min(top, int(self.level[node])), -1, -1):
            near = self._layer(q, [at for _, at in near], i, ef)
            room = self.links[i].shape[1]
            chosen = self._choose(near, room if i else room // 2)
            self.links[i][node, : len(chosen)] = chosen
            for other in chosen:
                row = self.links[i][other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:  # the other node chooses anew among its links and this one
                    all_ = np.append(row, node)
                    s = self.z[all_] @ self.z[other]
                    kept = self._choose(sorted(zip(s.tolist(), all_.tolist(), strict=True), reverse=True), room)
                    row[:] = -1
                    row[: len(kept)] = kept
        if self.level[node] > top:
            self.entry = node

    def _choose(self, near: list[tuple[float, int]], room: int) -> list[int]:
        """Of nodes by falling similarity, those that are nearer to the node than to one already chosen; then the nearest of the rest."""
        chosen: list[int] = []
        left: list[int] = []
        for s, c in near:
            if len(chosen) == room:
                break
            (left if chosen and float((self.z[chosen] @ self.z[c]).max()) > s else chosen).append(c)
        return (chosen + left)[:room]

    def _climb(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.z[at] @ q)
        while True:
            near = self.links[level][at]
            near = near[near >= 0]
            if not len(near):
                return at
            s = self.z[near] @ q
            j = int(s.argmax())
            if s[j] <= best:
                return at
            best, at = float(s[j]), int(near[j])

    def _layer(self, q: np.ndarray, start: list[int], level: int, ef: int) -> list[tuple[float, int]]:
        """(similarity, node) of the ef best found, falling."""
        seen = set(start)
        s = (self.z[start] @ q).tolist()
        todo = [(-x, a) for x, a in zip(s, start, strict=True)]
        best = [(x, -a) for x, a in zip(s, start, strict=True)]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        links = self.links[level]
        while todo:
            x, a = heapq.heappop(todo)
            if len(best) == ef and -x < best[0][0]:
                break
            new = [c for c in links[a].tolist() if c >= 0 and c not in seen]
            if not new:
                continue
            seen.update(new)
            for y, c in zip((self.z[new] @ q).tolist(), new, strict=True):
                if len(best) < ef or (y, -c) > best[0]:
                    heapq.heappush(todo, (-y, c))
                    heapq.heappush(best, (y, -c))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted(((x, -a) for x, a in best), key=lambda p: (-p[0], p[1]))

    def search(self, q: np.ndarray, k: int, ef: int = EF) -> list[tuple[float, int]]:
        """(similarity, place) of about the k nearest, falling."""
        if not len(self.ids):
            return []
        at = self.entry
        for i in range(int(self.level[at]), 0, -1):
            at = self._climb(q, at, i)
        return self._layer(q, [at], 0, max(k, ef))[:k]

    def pack(self) -> dict:
        upper = [x[np.flatnonzero(self.level >= i)] for i, x in enumerate(self.links)]
        return {"dim": self.z.shape[1], "ids": self.ids.tobytes(), "z": self.z.tobytes(), "level": self.level.astype(np.uint8).tobytes(), "links": b"".join(x.tobytes() for x in upper), "entry": self.entry}

    @staticmethod
    def unpack(row: dict, m: int) -> Graph:
        ids, level = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["level"], np.uint8).astype(np.int64)
        links, at = [], 0
        raw = np.frombuffer(row["links"], np.int32)
        for i in range(int(level.max(initial=0)) + 1):
            here = np.flatnonzero(level >= i)
            width = 2 * m if i == 0 else m
            x = np.full((len(ids), width), -1, np.int32)
            x[here] = raw[at : at + len(here) * width].reshape(-1, width)
            links.append(x)
            at += len(here) * width
        return Graph(ids, np.frombuffer(row["z"], np.float64).reshape(len(ids), row["dim"]), level, links, row["entry"])


def build(refs: DataFrame, shard_rows: int = SHARD_ROWS, m: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """The graphs of refs (ref_id, z), a row for each shard of about ``shard_rows`` references: INDEX."""
    dims = refs.groupBy(F.size("z").alias("d")).agg(F.count("*").alias("n")).filter("d > 0")
    common = dims.orderBy(F.desc("n"), "d").limit(1).collect()  # the length that most vectors have
    dim, n = (common[0]["d"], common[0]["n"]) if common else (0, 0)
    shards = max(1, -(-n // shard_rows))

    def one(t: pa.Table) -> pa.Table:
        at, z = _sound(t.column("z").combine_chunks(), dim)
        ids = t.column("ref_id").to_numpy()[at].astype(np.int64)
        rows = [{"shard": t.column("shard")[0].as_py(), **Graph.build(ids, z, m, ef).pack()}] if len(at) else []
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "z", "level", "links")), ("entry", pa.int32())]))

    dealt = refs.filter("ref_id IS NOT NULL").select(F.pmod(F.xxhash64("ref_id"), F.lit(shards)).cast("int").alias("shard"), "ref_id", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches()

    return dealt.repartitionById(shards, "shard").mapInArrow(run, INDEX)  # a task for each shard: small as their rows are, they are long to build


def search(queries: DataFrame, index: DataFrame, keep: list[str], k: int, ef: int = EF, m: int = LINKS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(keep, ref_id, s, rank) of about the k nearest references; keep must name the query rows. index had better be a table."""
    spark = queries.sparkSession
    shards = [r["shard"] for r in index.select("shard").collect()]  # a number for each shard
    parts = max(1, -(-queries.count() // query_rows))
    place = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    every = F.broadcast(spark.createDataFrame([(x,) for x in shards], "shard int")) if shards else spark.createDataFrame([], "shard int")
    q = queries.select(*keep, "z").withColumn("part", F.pmod(F.xxhash64(*keep), F.lit(parts)).cast("int")).crossJoin(every)
    schema = f"{_own(queries, keep)}ref_id long, s double"
    names = [c.split()[0] for c in schema.split(", ")]

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        row = right.to_pylist()[0]
        g = Graph.unpack(row, m)
        at, z = _sound(left.column("z").combine_chunks(), row["dim"])
        found = [g.search(x, k, ef) for x in z]
        i = np.repeat(at, [len(f) for f in found])
        own = left.select(keep).take(pa.array(i))
        flat = [p for f in found for p in f]
        return pa.table([*own.columns, pa.array(g.ids[[p[1] for p in flat]] if flat else [], pa.int64()), pa.array([p[0] for p in flat], pa.float64())], names)

    met = q.groupBy("shard", "part").cogroup(index.select("*", place.alias("part")).groupBy("shard", "part")).applyInArrow(one, schema)
    w = Window.partitionBy(*keep).orderBy(F.desc("s"), "ref_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
