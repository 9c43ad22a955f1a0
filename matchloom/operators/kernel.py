"""Arrow kernels over groups of rows: one shuffle by key, many groups a batch, no frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_OUT = 50_000


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys of sorted batches, each as one batch; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cut = (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()
        for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
            if held and k[i] != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


ROWS_TOGETHER, PAIRS_AT_ONCE = 20_000, 1 << 20  # rows from which on groups that are solved together are enough; pairs of rows that are held at once


def places(key: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for the runs of equal keys."""
    return np.cumsum(np.concatenate([np.zeros(min(len(key), 1), np.int64), key[1:] != key[:-1]]), dtype=np.int64)


def pairs_within(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs a[i] == b[j], by i, then j, some of them at a time."""
    by = np.argsort(b, kind="stable")
    low = np.searchsorted(b[by], a)
    many = np.searchsorted(b[by], a, "right") - low
    for i, j in expanded(low, many):
        yield i, by[j]


def expanded(low: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with j from low[i] on, ``many[i]`` of them, some at a time."""
    edge = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(at, to), many[at:to])
        yield i, low[i] + np.arange(edge[at], edge[to]) - edge[i]
        at = to


def per_group(df: DataFrame, key: str, solve: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, together: int = 0) -> DataFrame:
    """solve over each group of df by key (bounded groups: what one scene holds), as columns of arrays.

    Rows without a key take no part. Groups arrive whole; the order of their rows is not defined. With ``together``, solve
    gets whole groups, one after another, until they have so many rows.
    """
    fields = StructType.fromDDL(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        made: list[dict[str, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[n] for m in made])).cast(target.field(n).type) for n in names], names)

        def whole() -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for g in groups(batches, key):
                held.append(g)
                if sum(h.num_rows for h in held) >= together:
                    yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for g in whole():
            got = solve({n: c.to_numpy(zero_copy_only=False) for n, c in zip(g.schema.names, g.columns, strict=True)})
            if len(got[names[0]]):
                made.append(got)
                size += len(got[names[0]])
            if size > ROWS_OUT:
                yield out()
                made, size = [], 0
        if made:
            yield out()

    # Dealt by a hash of the key: an exchange by the key itself is left out over a union whose sides were dealt by it, although
    # adaptive execution may have merged the partitions of those sides differently.
    return df.filter(df[key].isNotNull()).repartition(F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def streamed(df: DataFrame, key: str, order: list, start: Callable[[], dict], step: Callable[[dict, dict[str, np.ndarray]], None], finish: Callable[[dict], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Each group of df by key, of any size, as slices in ``order``: a state from ``start``, which ``step`` brings forward slice by slice and ``finish`` turns into columns.

    Rows without a key take no part. Only the state and one batch are held.
    """
    fields = StructType.fromDDL(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)

        def out(state: dict) -> pa.RecordBatch:
            got = finish(state)
            return pa.RecordBatch.from_arrays([pa.array(got[n]).cast(target.field(n).type) for n in names], names)

        state, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.names.index(key)).to_numpy(zero_copy_only=False)
            cut = (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()
            for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if state is None or k[i] != last:
                    if state is not None:
                        yield out(state)
                    state, last = start(), k[i]
                part = b.slice(i, j - i)
                step(state, {n: c.to_numpy(zero_copy_only=False) for n, c in zip(part.schema.names, part.columns, strict=True)})
        if state is not None:
            yield out(state)

    return df.filter(df[key].isNotNull()).repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
