"""Exact top-k inner products by a Voronoi kNN join.

Vectors are grouped by their nearest pivot; there are about as many pivots as the square root
of the rows (``most_pivots`` at most).  The summary of a cell holds its size, its radius around the
pivot, the range of its vectors' lengths, and the distances of the k + 1 members nearest to the pivot.
A member v at distance d scores at least ``q.p - |q| d`` and ``(|q|^2 + |v|^2 - (|q - p| + d)^2) / 2``,
so the summaries alone give each query a floor under its k-th best score.  A cell's ceiling is the lesser of
``q.p + |q| r`` and ``(|q|^2 + max |v|^2 - e^2) / 2``, where e, the least distance to a member, is at least
``|q - p| - r`` and at least the distance to the plane between the cell and the query's own.  Only
cells whose ceiling reaches the floor can matter.

Neighbouring cells form groups of about ``block`` rows (halved along their main direction); a query is
replicated to the groups that hold a cell that matters and nowhere else, groups without visitors
are not sent, groups are solved locally, and the local winners meet in one small merge.
A cell above ``block`` rows is a group of its own, cut into blocks by a hash
of the id, and the queries of a group likewise, so a task holds one tile.

Pivots are a bounded sample (the vectors of smallest id hash);
every row is grouped and searched, and the bounds hold for any pivots, so results are exact.

Defined results: vectors that are null or hold null or non-finite components
take no part; components whose products could pass 64 bits are an error before any search; shorter vectors are padded with zeros; a query's own id is no
candidate; equal scores go to the smaller id; repeated ids are rows of their
own, fewer than k candidates give fewer ranks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stash as S

OUT = "query_id long, vec_id long, score long"


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as a matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten().cast(pa.int64()), dtype=np.int64)
    if (length == dim).all():
        return flat.reshape(len(length), dim)
    out = np.zeros((len(length), dim), dtype=np.int64)
    out[np.arange(dim)[None, :] < length[:, None]] = flat
    return out


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x: floor(scale * component) as longs, of the vectors that take part; one of 2^62 or more is an error."""
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) <> double('Infinity'))"
    return vectors.filter(sound).select("vec_id", F.expr(f"transform(embedding, c -> CASE WHEN abs({scale} * CAST(c AS DOUBLE)) < {2.0**62!r}D THEN CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) ELSE raise_error(concat('component ', c, ' is too large for whole numbers')) END)").alias("x"))


def dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; through float64 where every partial sum stays below 2**53."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of one tile: (query ids, ids, scores); ties to the smaller id; own id left out."""
    order = np.argsort(vid, kind="stable")
    v, vid = v[order], vid[order]
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(q), rows):
        s = dots(q[lo : lo + rows], v)
        own = vid[None, :] == qid[lo : lo + rows, None]
        keep = min(len(vid), k + int(own.sum(axis=1).max(initial=0)))
        # the keep-th best score of a row bounds what can matter; ties beyond are cut by the stable sort
        floor = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
        i, j = np.nonzero((s >= floor[:, None]) & ~own)
        o = np.lexsort((j, -s[i, j], i))
        i, j = i[o], j[o]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[rank < k], j[rank < k]
        out.append((qid[lo + i], vid[j], s[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Cells:
    """Pivots and what is known of their cells; at most ``most_pivots`` rows, held by the driver and sent to workers."""

    def __init__(self, centre: np.ndarray, summary: dict[int, tuple], k: int, block: int):
        self.centre, self.k, p = centre, k, len(centre)
        self.norm = (centre**2).sum(axis=1)
        get = lambda at, none: np.array([summary[i][at] if i in summary else none for i in range(p)])
        self.size, self.radius, self.short, self.long = get(0, 0), get(1, 0.0), get(2, 0.0), get(3, 0.0)
        self.near = np.full((p, k + 1), np.inf)
        for i, row in summary.items():
            self.near[i, : len(row[4])] = sorted(row[4])
        gap = np.sqrt(np.maximum(self.norm[:, None] - 2 * centre @ centre.T + self.norm, 0))
        self.gap = np.where(gap > 0, gap, np.inf)
        self.group = self._groups(block)

    def _groups(self, block: int) -> np.ndarray:
        out, todo, n = np.zeros(len(self.centre), np.int64), [np.flatnonzero(self.size > 0)], 0
        while todo:
            at = todo.pop()
            if len(at) <= 1 or self.size[at].sum() <= block:
                out[at] = n
                n += 1
                continue
            x = self.centre[at] - self.centre[at].mean(axis=0)
            side = x @ np.linalg.svd(x, full_matrices=False)[2][0]
            o = np.argsort(side, kind="stable")
            half = int(np.clip(np.searchsorted(np.cumsum(self.size[at][o]), self.size[at].sum() / 2), 1, len(at) - 1))
            todo += [at[o[half:]], at[o[:half]]]
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ self.centre.T + self.norm, 0))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, group) of all groups that can hold one of the k best."""
        live, q2 = self.size > 0, (x**2).sum(axis=1)[:, None]
        length, middle, d = np.sqrt(q2), x @ self.centre.T, self.distances(x)
        slack = 1e-7 * (np.abs(middle) + length * self.radius + q2 + self.long**2) + 1e-6  # distances are differences of squares
        own = d.argmin(axis=1)
        plane = (d**2 - (d[np.arange(len(x)), own] ** 2)[:, None]) / (2 * self.gap[own])
        least = np.maximum(np.maximum(d - self.radius, plane) * (1 - 1e-9) - 1e-6, 0)
        high = np.minimum(middle + length * self.radius, (q2 + self.long**2 - least**2) / 2) + slack
        low = np.maximum(middle[:, :, None] - length[:, :, None] * self.near, (q2[:, :, None] + (self.short**2)[:, None] - (d[:, :, None] + self.near) ** 2) / 2) - slack[:, :, None]
        low = np.where(np.isfinite(self.near) & live[:, None], low, -np.inf).reshape(len(x), -1)
        keep = self.k + 1  # one may be the query itself
        floor = -np.partition(-low, keep - 1, axis=1)[:, keep - 1] if low.shape[1] >= keep else np.full(len(x), -np.inf)
        i, j = np.nonzero((high >= floor[:, None]) & live)
        pair = np.unique(i * (self.group.max(initial=0) + 1) + self.group[j])
        return pair // (self.group.max(initial=0) + 1), pair % (self.group.max(initial=0) + 1)

    def rows_at_once(self) -> int:
        return max(1, (1 << 21) // (len(self.centre) * (self.k + 1)))


def voronoi(vectors: DataFrame, k: int, pivots: int | None, most_pivots: int, block: int) -> tuple[Cells, DataFrame, int] | None:
    """Cells of vectors (vec_id, x), the vectors with their cell, and the dimension; None without vectors."""
    n, dim, low, high = vectors.agg(F.count("*"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).collect()[0]
    if not n:
        return None
    dim = max(int(dim or 0), 1)
    if dim * max(abs(int(low or 0)), abs(int(high or 0))) ** 2 >= 2**63:
        raise ValueError(f"components from {low} to {high} are too large: their products could pass 64 bits")
    pivots = pivots or min(most_pivots, int(np.ceil(np.sqrt(n))))
    sample = vectors.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()
    centre = np.zeros((len(sample), dim))
    for i, x in enumerate(sample["x"]):
        centre[i, : len(x)] = x
    first = Cells(np.unique(centre, axis=0), {}, k, block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, first.rows_at_once()):
                b = whole.slice(lo, first.rows_at_once())
                x = _dense(b.column(1), dim).astype(np.float64)
                near = first.distances(x).argmin(axis=1)
                far = np.sqrt(((x - first.centre[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(axis=1)))], ["vec_id", "x", "cell", "far", "length"])

    placed = S.stash(vectors.select("vec_id", "x").mapInArrow(place, "vec_id long, x array<long>, cell int, far double, length double"), "placed")
    near = placed.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).filter(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list("far").alias("near"))
    known = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.min("length").alias("short"), F.max("length").alias("long")).join(near, "cell")
    cells = Cells(first.centre, {r.cell: (r.n, r.r, r.short, r.long, r.near) for r in known.collect()}, k, block)  # a row per pivot
    return cells, placed, dim


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, most_pivots: int = 4096, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors of (vec_id, x)."""
    spark = vectors.sparkSession
    made = voronoi(vectors, k, pivots, most_pivots, block)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, placed, dim = made

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, cells.rows_at_once()):
                b = whole.slice(lo, cells.rows_at_once())
                i, g = cells.visits(_dense(b.column(1), dim).astype(np.float64))
                idx = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(g.astype(np.int32))], ["query_id", "q", "grp"])

    asked = S.stash(queries.select("vec_id", "x").mapInArrow(bound, "query_id long, q array<long>, grp int"), "asked")
    # Tiles: (group, data block, query block); the data go to every query block of a group and the queries to every data block.
    visitors = {r.grp: r.n for r in asked.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row per group
    held = np.bincount(cells.group, weights=cells.size, minlength=1).astype(int)
    plan = [(int(g), max(1, -(-int(held[g]) // block)), -(-n // query_block)) for g, n in visitors.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "grp int, nd int, nq int"))
    group = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(cells.group)], "cell int, grp int"))
    data = placed.select("cell", "vec_id", "x").join(group, "cell").join(plan, "grp").select("grp", F.pmod(F.xxhash64("vec_id"), "nd").cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("w"), "vec_id", "x")
    ask = asked.join(plan, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("d"), F.pmod(F.xxhash64("query_id", F.lit(7)), "nq").cast("int").alias("w"), "query_id", "q")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _dense(left.column("q"), dim), _dense(right.column("x"), dim)
        a, b, s = best(q, left.column("query_id").to_numpy(), v, right.column("vec_id").to_numpy(), k) if len(q) and len(v) else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    tiles = ask.groupBy("grp", "d", "w").cogroup(data.groupBy("grp", "d", "w")).applyInArrow(solve, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
