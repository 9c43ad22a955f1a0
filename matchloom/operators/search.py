"""Exact and approximate gallery search, and the open-set decision.

The gallery is broadcast only after its size is checked; larger ones are cut
into blocks that meet every query block in a grid of tasks. Either way a kernel multiplies blocks
of vectors and reduces what it sees before anything is emitted: the best of each label, the k nearest,
or counts; only ``similarities`` without ``per_label`` emits all pairs. Partial results are merged by the same order.

Similarities are dot products in double precision and are compared as they are; queries round what they return.
``places`` rounds before any comparison, for callers that want near ties to be ties.

Defined results: vectors that are null, hold null or non-finite components or have another length than the gallery's
take no part: as references they are never found, as queries they find nothing and are undecided; repeated query rows
are answered each; repeated references are references each; an empty gallery answers no one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_BYTES = 64 << 20
QUERY_ROWS = 50_000
AT_ONCE = 512  # queries that meet a block of references in one product
PAIRS_AT_ONCE = 1 << 22  # pairs of a block whose similarities are held at once
SPREAD_REFS = 1 << 13  # a broadcast gallery of so many rows meets queries dealt over all cores


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix; all must be sound and of one length."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, dim or 0)


def _sound(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that take part, their matrix)."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    value = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    end = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    at = np.flatnonzero((size == dim) & (bad[end] == bad[end - np.maximum(size, 0)]))
    if dim == 0 or not len(at):
        return at[:0], np.zeros((0, dim))
    return at, value[(end[at] - dim)[:, None] + np.arange(dim)]


class Refs:
    """A block of the gallery as arrays."""

    def __init__(self, t: pa.Table, dim: int):
        t = t.combine_chunks()
        column = t.column("z").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float32()))
        at, self.z = _sound(column, dim)
        self.ref_id, self.label_id, self.insert_no = (t.column(c).to_numpy()[at] if t.num_rows and c in t.column_names else np.zeros(0, np.int64) for c in ("ref_id", "label_id", "insert_no"))

    def slice(self, at: int, rows: int) -> Refs:
        """Rows at, at + 1, ... of the block."""
        out = object.__new__(Refs)
        out.ref_id, out.label_id, out.insert_no, out.z = (x[at : at + rows] for x in (self.ref_id, self.label_id, self.insert_no, self.z))
        return out


Fold = Callable[[np.ndarray, pa.RecordBatch, Refs], list[pa.Array]]
Allowed = Callable[[pa.RecordBatch, Refs], np.ndarray]
REF = ["ref_id", "label_id", "insert_no", "z"]


def fold_pairs(queries: DataFrame, refs: DataFrame, keep: list[str], fold: Fold, names: str, places: int | None = None) -> DataFrame:
    """What fold makes of blocks of similarities: fold(s, queries' columns keep, refs) gives the columns of ``names`` (DDL).

    A query meets the gallery in one block where that is broadcast, in several otherwise, so callers merge by query.
    In a grid, equal query rows are folded once and written out as often as they occur.
    """
    spark = queries.sparkSession
    stats = refs.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("d")).collect()[0]
    dim = max(stats["d"] or 0, 0)

    def emit(b: pa.RecordBatch, r: Refs) -> Iterator[pa.RecordBatch]:
        step = max(1, min(AT_ONCE, PAIRS_AT_ONCE // max(len(r.z), 1)))
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            at, q = _sound(part.column(part.num_columns - 1), dim)
            if not len(at) or not len(r.z):
                continue
            s = q @ r.z.T
            own = part.select(keep).take(pa.array(at)) if keep else part.select([])
            columns = fold(np.round(s, places) if places is not None else s, own, r)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in names.split(", ")])

    if (stats["n"] or 0) * dim * 8 <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(Refs(refs.select(*REF).toArrow(), dim))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from emit(b, held.value)

        asked = queries.select(*keep, "z")
        if (stats["n"] or 0) >= SPREAD_REFS:  # rows of few files, or of merged partitions, would meet a large gallery in few tasks
            parts = _spread(1, queries.count(), 1, spark)
            asked = asked.repartitionById(parts, F.pmod(F.xxhash64(*asked.columns), F.lit(parts)).cast("int"))
        return asked.mapInArrow(run, names)

    blocks = int(-(-int(stats["n"]) * dim * 8 // BROADCAST_BYTES))
    rows = queries.count()
    parts = _spread(-(-rows // QUERY_ROWS), rows, blocks, spark)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("p") * blocks + F.col("b")).alias("cell")
    r = refs.select(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)).cast("int").alias("b"), span(parts).alias("p"), *REF).select(cell, *REF)
    some = queries.select(*keep, "z").groupBy(*keep, "z").agg(F.count("*").alias("_times"))
    q = some.select(span(blocks).alias("b"), F.pmod(F.xxhash64(*keep, "z"), F.lit(parts)).cast("int").alias("p"), *keep, "_times", "z").select(cell, *keep, "_times", "z")

    def solve(mine: pa.Table, theirs: pa.Table) -> Iterator[pa.RecordBatch]:
        block = Refs(theirs, dim)
        for b in mine.select([*keep, "_times", "z"]).to_batches():
            times = b.column(len(keep)).to_numpy()
            for i in np.unique(times).tolist():
                for x in emit(b.filter(pa.array(times == i)).select([*keep, "z"]), block):
                    yield x.append_column("_times", pa.array(np.full(x.num_rows, i)))

    out = _in_cells(q, r, blocks * parts, solve, f"{names}, _times long")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_i")).drop("_times")


def _in_cells(q: DataFrame, r: DataFrame, cells: int, solve: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], names: str) -> DataFrame:
    """What solve makes of each cell's queries and references (cell, z, ...): a task for each cell, which yields as it goes."""
    own = [c for c in q.columns if c not in ("cell", "z")]
    both = q.select("cell", "z", *(F.col(c).alias(f"q_{c}") for c in own), F.lit(True).alias("asks")).unionByName(r.select("cell", *REF, F.lit(False).alias("asks")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            asks = t.column("asks")
            mine = t.filter(asks).select([*(f"q_{c}" for c in own), "z"]).rename_columns([*own, "z"]).combine_chunks()
            yield from solve(mine, t.filter(pa.compute.invert(asks)).select(REF))

    return both.repartitionById(cells, "cell").drop("cell").mapInArrow(run, names)


def _spread(parts: int, rows: int, blocks: int, spark: SparkSession) -> int:
    """So many parts of the queries that every core has some cells, but no part is very small."""
    tasks = CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    return max(1, parts, min(-(-rows // (4 * TILE[0])), -(-tasks // blocks)))


TILE = (256, 1024)  # queries and references of one product: what a kernel makes of it stays in the processor's cache
CELL_QUERIES, CELL_BYTES, CELLS_PER_CORE = 1 << 14, 32 << 20, 3
SOME, ROWS_AT_ONCE = 1 << 15, 1 << 12  # pairs multiplied each for itself at once; rows that leave a cell together


ROUGH = (1e-9, 1e15)  # largest norms whose products can be looked at in single precision first


class Pairs:
    """All pairs of queries and references, dealt into cells of a bounded number of rows of each; a task multiplies a cell in tiles.

    Every product has the same shape (cells are filled up with zeros), so a pair's similarity is the same number in every pass.
    With ``floor`` (not over non-finite numbers), passes look at pairs from there on only: a product in single precision rules out
    those that its error cannot lift to the floor, and each of the others is multiplied for itself, in every pass alike.
    """

    def __init__(self, queries: DataFrame, refs: DataFrame, keep: list[str] | None = None, floor: float | None = None):
        self.queries, self.refs, self.keep = queries, refs, keep or []
        norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        odd = F.isnan(norm) | (norm == math.inf)
        size = lambda df: df.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("d"), F.max(F.when(~odd, norm)).alias("norm"), F.count_if(odd).alias("odd")).collect()[0]
        q, r = size(queries), size(refs)
        self.dim = max(r["d"] or 0, 0)
        self.bound = (q["norm"] or 0.0) * (r["norm"] or 0.0) or 1.0  # no similarity is larger (Cauchy and Schwarz)
        self.wild = bool(q["odd"] or r["odd"]) or not self.bound < 1e300
        self.floor = None if self.wild else floor
        self.rough = np.float32 if not self.wild and all(ROUGH[0] <= (x["norm"] or 0.0) <= ROUGH[1] for x in (q, r)) else np.float64
        self.error = (self.dim + 4) * float(np.finfo(self.rough).eps) * self.bound  # of a product in that precision, twice over
        self.blocks = max(1, -(-r["n"] * max(self.dim, 1) * 8 // CELL_BYTES))
        self.parts = _spread(-(-q["n"] // CELL_QUERIES), q["n"], self.blocks, queries.sparkSession)

    def _cells(self, keep: list[str], work: Callable[[pa.Table, np.ndarray, Refs], Iterator[list[pa.Array]]], names: str) -> DataFrame:
        """The rows of ``names`` (DDL) that work makes of each cell: (queries' columns keep, their matrix, references)."""
        dim, parts, blocks = self.dim, self.parts, self.blocks
        header = [c.split()[0] for c in names.split(", ")]
        span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        deal = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
        cell = (F.col("p") * blocks + F.col("b")).alias("cell")
        q = self.queries.select(deal(self.queries, parts).alias("p"), span(blocks).alias("b"), *keep, "z").select(cell, *keep, "z")
        r = self.refs.select(deal(self.refs, blocks).alias("b"), span(parts).alias("p"), *REF).select(cell, *REF)

        def solve(mine: pa.Table, theirs: pa.Table) -> Iterator[pa.RecordBatch]:
            block = Refs(theirs, dim)
            at, x = _sound(mine.column("z").combine_chunks(), dim) if mine.num_rows else (np.zeros(0, np.int64), np.zeros((0, dim)))
            kept = mine.select(keep).take(pa.array(at)).combine_chunks()
            if len(at) and len(block.z):
                for columns in work(kept, x, block):
                    yield pa.RecordBatch.from_arrays(columns, header)

        return _in_cells(q, r, parts * blocks, solve, names)

    def gather(self, start: Callable, names: str) -> DataFrame:
        """The rows of ``names`` (DDL) that states make: start() gives a cell's state, add(s, own, r) sees each tile, and both add and end() yield lists of columns.

        A state with a ``level`` sees by some(s, i, j, rows, own, r) those pairs (i, j) of a tile of so many rows that reach it; it may raise it as it goes.
        """
        keep, rough, error = self.keep, self.rough, self.error

        def work(kept: pa.Table, x: np.ndarray, block: Refs) -> Iterator[list[pa.Array]]:
            state, n = start(), len(x)
            screened = getattr(state, "level", None) is not None
            x, z = (np.concatenate([m, np.zeros((-len(m) % size, m.shape[1]))]) for m, size in zip((x, block.z), TILE, strict=True))
            a, b = (m.astype(rough) if screened else m for m in (x, z))
            out = np.empty(TILE, a.dtype)
            for i in range(0, n, TILE[0]):
                rows = kept.slice(i, TILE[0]).to_batches()[0] if keep else pa.RecordBatch.from_arrays([], [])
                for j in range(0, len(block.z), TILE[1]):
                    np.matmul(a[i : i + TILE[0]], b[j : j + TILE[1]].T, out=out)
                    s, r = out[: n - i, : len(block.z) - j], block.slice(j, TILE[1])
                    if not screened:
                        yield from state.add(s, rows, r)
                        continue
                    at = np.flatnonzero(s >= np.nextafter(rough(state.level - error), rough(-np.inf)))
                    for lo in range(0, max(len(at), 1), SOME):
                        k, m = np.divmod(at[lo : lo + SOME], s.shape[1])
                        one = np.einsum("ij,ij->i", x[i + k], z[j + m])
                        live = one >= state.level
                        yield from state.some(one[live], k[live], m[live], len(s) if lo == 0 else 0, rows, r)
            yield from state.end()

        return self._cells(keep, work, names)

    def best(self, labels: list[int]) -> DataFrame:
        """(keep, m): a query's best similarity with each of a few rising labels, as doubles (-inf: none); a row for each block that it meets, so callers merge."""
        label, rough, error = np.array(labels, np.int64), self.rough, self.error

        def work(kept: pa.Table, x: np.ndarray, block: Refs) -> Iterator[list[pa.Array]]:
            place = np.searchsorted(label, block.label_id)
            both = np.ascontiguousarray(np.concatenate([place[:, None].astype(np.float64), block.z], axis=1))
            once = np.unique(both.view(f"V{both.shape[1] * 8}").ravel(), return_index=True)[1]  # copies of a reference say nothing new
            once = once[np.argsort(place[once], kind="stable")]
            n, place = len(x), place[once]
            x, z = (np.concatenate([m, np.zeros((-len(m) % size, m.shape[1]))]) for m, size in zip((x, block.z[once]), TILE, strict=True))
            a, b = x.astype(rough), z.astype(rough)
            out, found = np.empty(TILE, rough), np.full((n, len(label)), -np.inf)
            for j in range(0, len(place), TILE[1]):
                mine = place[j : j + TILE[1]]
                cuts = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(mine)]
                for i in range(0, n, TILE[0]):
                    np.matmul(a[i : i + TILE[0]], b[j : j + TILE[1]].T, out=out)
                    for lo, hi in zip(cuts, cuts[1:], strict=False):
                        s, best = out[: n - i, lo:hi], found[i : i + TILE[0], mine[lo]]
                        top = s.max(axis=1).astype(np.float64)
                        row = np.flatnonzero(top >= best - error)
                        k, m = np.nonzero(s[row] >= np.maximum(top - 2 * error, best - error)[row, None])
                        for at in range(0, len(k), SOME):
                            r, c = row[k[at : at + SOME]], m[at : at + SOME]
                            np.maximum.at(best, r, np.einsum("ij,ij->i", x[i + r], z[j + lo + c]))
            for lo in range(0, n, ROWS_AT_ONCE):
                yield [*(c.combine_chunks() for c in kept.slice(lo, ROWS_AT_ONCE).columns), pa.array([v.tobytes() for v in found[lo : lo + ROWS_AT_ONCE]], pa.binary())]

        some = Pairs.__new__(Pairs)
        some.__dict__ |= self.__dict__ | {"refs": self.refs.filter(F.col("label_id").isin(labels))}
        return some._cells(self.keep, work, f"{_own(self.queries, self.keep)}m binary")


def _own(queries: DataFrame, keep: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in queries.select(*keep).schema)


def _copies(df: DataFrame) -> list[str]:
    return ["_i"] if "_i" in df.columns else []


def similarities(queries: DataFrame, refs: DataFrame, keep: list[str], per_label: bool = False, least: float | None = None, places: int | None = None, allowed: Allowed | None = None) -> DataFrame:
    """All pairs (keep, ref_id, label_id, insert_no, s), or the best of each label (keep, label_id, s); only s >= least.

    ``allowed`` chooses among the pairs inside the kernel.
    """

    def best(s: np.ndarray, own: pa.RecordBatch, r: Refs) -> list[pa.Array]:
        order = np.argsort(r.label_id, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(r.label_id[order]) != 0]))
        s = np.maximum.reduceat(s[:, order], heads, axis=1)
        i, j = np.nonzero(s >= (least if least is not None else -np.inf))
        return [*(c.take(pa.array(i)) for c in own.columns), pa.array(r.label_id[order][heads][j].astype(np.int32)), pa.array(s[i, j])]

    def all_(s: np.ndarray, own: pa.RecordBatch, r: Refs) -> list[pa.Array]:
        hit = s >= (least if least is not None else -np.inf)
        i, j = np.nonzero(hit & allowed(own, r) if allowed is not None else hit)
        return [*(c.take(pa.array(i)) for c in own.columns), pa.array(r.ref_id[j]), pa.array(r.label_id[j].astype(np.int32)), pa.array(r.insert_no[j]), pa.array(s[i, j])]

    if per_label:
        out = fold_pairs(queries, refs, keep, best, f"{_own(queries, keep)}label_id int, s double", places)
        return out.groupBy(*keep, *_copies(out), "label_id").agg(F.max("s").alias("s")).drop("_i") if _copies(out) else out
    return fold_pairs(queries, refs, keep, all_, f"{_own(queries, keep)}ref_id long, label_id int, insert_no long, s double", places).drop("_i")


def nearest(queries: DataFrame, refs: DataFrame, keep: list[str], k: int, allowed: Allowed | None = None, places: int | None = None) -> DataFrame:
    """(keep, ref_id, label_id, insert_no, s, rank): the k nearest references of each query, by s, then ref_id.

    ``allowed`` gives the matrix of pairs (queries x references) that may be answered.
    """

    def top(s: np.ndarray, own: pa.RecordBatch, r: Refs) -> list[pa.Array]:
        ok = allowed(own, r) if allowed is not None else np.ones_like(s, dtype=bool)
        order = np.argsort(r.ref_id, kind="stable")
        s, ok = np.where(ok, s, -np.inf)[:, order], ok[:, order]
        m = min(k, s.shape[1])
        floor = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero((s >= floor[:, None]) & ok)
        o = np.lexsort((j, -s[i, j], i))
        i, j = i[o], j[o]
        first = (np.arange(len(i)) - np.searchsorted(i, i)) < k
        i, at = i[first], order[j[first]]
        return [*(c.take(pa.array(i)) for c in own.columns), pa.array(r.ref_id[at]), pa.array(r.label_id[at].astype(np.int32)), pa.array(r.insert_no[at]), pa.array(s[i, j[first]]), pa.array((np.arange(len(i)) - np.searchsorted(i, i) + 1).astype(np.int32))]

    out = fold_pairs(queries, refs, keep, top, f"{_own(queries, keep)}ref_id long, label_id int, insert_no long, s double, rank int", places)
    if not _copies(out):
        return out
    w = Window.partitionBy(*keep, "_i").orderBy(F.desc("s"), "ref_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_i")


OWN = ["own", "own_label", "own_no"]
LABEL_ROWS = 4096  # rows of a label that meet as many others at once


def fold_within(refs: DataFrame, fold: Fold, names: str) -> DataFrame:
    """What fold makes of the similarities of references of one label: fold(s, columns OWN of the first, second) gives the columns of ``names`` (DDL).

    Labels are multiplied each by itself, large ones in blocks of about ``LABEL_ROWS`` rows, so a row meets its own label only. Rows without a label take no part.
    """
    dim = max(refs.agg(F.max(F.size("z"))).collect()[0][0] or 0, 0)
    some = refs.select(*REF).filter("label_id IS NOT NULL")
    blocks = some.groupBy(F.col("label_id").alias("_label")).agg(F.ceil(F.count("*") / LABEL_ROWS).alias("nb"))
    placed = some.join(blocks, F.col("label_id") == F.col("_label")).withColumn("blk", F.pmod(F.xxhash64("ref_id"), F.col("nb")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    left = placed.select(F.col("label_id").alias("l"), F.col("blk").alias("i"), every.alias("j"), F.col("ref_id").alias("own"), F.col("label_id").alias("own_label"), F.col("insert_no").alias("own_no"), F.col("z").alias("q"))
    right = placed.select(F.col("label_id").alias("m"), every.alias("g"), F.col("blk").alias("h"), "ref_id", "insert_no", "z")
    header = [c.split()[0] for c in names.split(", ")]

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(names)).empty_table()

    def solve(one: pa.Table, two: pa.Table) -> pa.Table:
        r, made = Refs(two, dim), []
        step = max(1, min(AT_ONCE, PAIRS_AT_ONCE // max(len(r.z), 1)))
        for lo in range(0, one.num_rows, step):
            part = one.select([*OWN, "q"]).slice(lo, step).combine_chunks()
            at, q = _sound(part.column("q").combine_chunks(), dim)
            if len(at) and len(r.z):
                own = part.select(OWN).take(pa.array(at)).combine_chunks().to_batches()[0]
                columns = fold(q @ r.z.T, own, r)
                if len(columns[0]):
                    made.append(pa.RecordBatch.from_arrays(columns, header))
        return pa.Table.from_batches(made) if made else empty

    return left.groupBy("l", "i", "j").cogroup(right.groupBy("m", "g", "h")).applyInArrow(solve, names)


def similarities_within(refs: DataFrame, least: float, allowed: Allowed) -> DataFrame:
    """(own, own_label, own_no, ref_id, insert_no, s): the pairs of one label that ``allowed`` chooses, with s >= least."""

    def some(s: np.ndarray, own: pa.RecordBatch, r: Refs) -> list[pa.Array]:
        i, j = np.nonzero((s >= least) & allowed(own, r))
        return [*(c.take(pa.array(i)) for c in own.columns), pa.array(r.ref_id[j]), pa.array(r.insert_no[j]), pa.array(s[i, j])]

    return fold_within(refs, some, f"{_own(refs.select(*(F.col(a).alias(b) for a, b in zip(REF, OWN, strict=False))), OWN)}ref_id long, insert_no long, s double")


def nearest_within(refs: DataFrame, allowed: Allowed) -> DataFrame:
    """(own, ref_id, s): the nearest reference of one label that ``allowed`` chooses, ties to the smaller ref_id."""

    def best(s: np.ndarray, own: pa.RecordBatch, r: Refs) -> list[pa.Array]:
        order = np.argsort(r.ref_id, kind="stable")
        s = np.where(allowed(own, r), s, -np.inf)[:, order]
        j = s.argmax(axis=1)
        top = s[np.arange(len(s)), j]
        live = np.flatnonzero(top > -np.inf)
        return [own.column(0).take(pa.array(live)), pa.array(r.ref_id[order][j[live]]), pa.array(top[live])]

    met = fold_within(refs, best, "own long, ref_id long, s double")
    m = met.groupBy("own").agg(F.max(F.struct("s", (-F.col("ref_id")).alias("neg"))).alias("m"))
    return m.select("own", (-F.col("m.neg")).alias("ref_id"), F.col("m.s").alias("s"))


def shares(queries: DataFrame, refs: DataFrame, levels: list[tuple[float, Callable[[Refs], np.ndarray] | None]], places: int | None = None) -> list[tuple[int, int]]:
    """(pairs, pairs with s >= level) for each level, over the references that its mask chooses: partial counts only."""

    def count(s: np.ndarray, own: pa.RecordBatch, r: Refs) -> list[pa.Array]:
        rows = [(i, s[:, m].size, int((s[:, m] >= level).sum())) for i, (level, mask) in enumerate(levels) for m in [mask(r) if mask is not None else slice(None)]]
        return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)]

    got = {r["i"]: (r["n"], r["k"]) for r in fold_pairs(queries, refs, [], count, "i int, n long, k long", places).groupBy("i").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()}
    return [got.get(i, (0, 0)) for i in range(len(levels))]


def decide(by_label: DataFrame, queries: DataFrame, keys: list[str], tau: float | None = None) -> DataFrame:
    """(keys, y_hat, s_star): the best label, the smaller id on ties; -1 below tau or without candidates.

    queries brings back rows that have no candidate at all.
    """
    best = by_label.groupBy(*keys).agg(F.max(F.struct("s", (-F.col("label_id")).alias("neg"))).alias("m"))
    out = queries.select(*keys).join(best, keys, "left").select(*keys, F.coalesce(-F.col("m.neg"), F.lit(-1)).cast("int").alias("y_hat"), F.col("m.s").alias("s_star"))
    if tau is None:
        return out
    return out.withColumn("y_hat", F.when(F.col("s_star") >= tau, F.col("y_hat")).otherwise(-1))


def margin(by_label: DataFrame, keys: list[str]) -> DataFrame:
    """Best less second-best label; 0 with one label."""
    w = Window.partitionBy(*keys).orderBy(F.desc("s"), "label_id")
    two = by_label.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return two.groupBy(*keys).agg((F.max("s") - F.min("s")).alias("margin"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lsh_plan(n: int, reach: float = 0.45, found: float = 0.95, bucket: int = 32) -> tuple[int, int]:
    """(bits, tables): bits grow with the gallery, so that a bucket holds about ``bucket`` rows of it; tables so that a pair of
    similarity ``reach`` meets in one of them with probability ``found``."""
    bits = max(1, round(math.log2(max(n / bucket, 2))))
    alike = (1 - math.acos(reach) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - found) / math.log(1 - alike)))


CODES_AT_ONCE = 1 << 14  # rows that leave lsh_codes together: rows grow by the tables, which grow with the gallery


def lsh_codes(planes: np.ndarray, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel that writes each row (vector last) once for each table with its bucket there, few rows at a time."""
    bits, dim = len(planes) // tables, planes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CODES_AT_ONCE // tables)
        for whole in batches:
            for lo in range(0, max(whole.num_rows, 1), step):
                b = whole.slice(lo, step)
                rows, z = _sound(b.column(b.num_columns - 1), dim)
                sign = (z @ planes.T > 0).reshape(len(rows), tables, bits)
                code = sign @ (1 << np.arange(bits)) if len(rows) else np.zeros((0, tables), int)
                i, t = np.indices(code.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows[i])) for c in b.columns), pa.array(t.astype(np.int32)), pa.array(code.ravel())], [*b.schema.names, "tab", "code"])

    return run


def lsh_search(queries: DataFrame, refs: DataFrame, keep: list[str], dim: int, bits: int | None = None, tables: int | None = None, seed: int = 0) -> DataFrame:
    """(keep, ref_id, s, candidates): approximate best reference of each query by random hyperplanes.

    Rows meet in the buckets of each table, where one product gives exact scores; only each bucket's best leaves it.
    candidates counts the pairs compared. Queries that meet no reference are left out.
    """
    auto = lsh_plan(refs.count())
    bits, tables = bits or auto[0], tables or auto[1]
    p = np.random.default_rng(seed).standard_normal((bits * tables, dim))

    def coded(df: DataFrame) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(lsh_codes(p, tables), f"{fields}, tab int, code long")

    own = _own(queries, keep)
    names = [*keep, "ref_id", "s", "n"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select([*keep, "z"])
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0).select(keep).append_column("ref_id", pa.array([], pa.int64())).append_column("s", pa.array([], pa.float64())).append_column("n", pa.array([], pa.int64()))
        _, q = _sound(left.column("z").combine_chunks(), dim)
        _, z = _sound(right.column("z").combine_chunks(), dim)
        rid = right.column("ref_id").to_numpy()
        order = np.argsort(rid, kind="stable")
        at, best = np.zeros(len(q), np.int64), np.zeros(len(q))
        for lo in range(0, len(q), AT_ONCE):
            s = q[lo : lo + AT_ONCE] @ z[order].T
            at[lo : lo + AT_ONCE] = s.argmax(axis=1)
            best[lo : lo + AT_ONCE] = s.max(axis=1)
        return pa.table([*(left.column(c) for c in keep), pa.array(rid[order][at]), pa.array(best), pa.array(np.full(len(q), len(z)))], names)

    q, r = coded(queries.select(*keep, "z")), coded(refs.select("ref_id", "z"))
    met = q.groupBy("tab", "code").cogroup(r.groupBy("tab", "code")).applyInArrow(solve, f"{own}ref_id long, s double, n long")
    top = met.groupBy(*keep).agg(F.max(F.struct("s", (-F.col("ref_id")).alias("neg"))).alias("m"), F.sum("n").alias("candidates"))
    return top.select(*keep, (-F.col("m.neg")).alias("ref_id"), F.col("m.s").alias("s"), "candidates")
