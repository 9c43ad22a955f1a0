"""Draws of NumPy's default generator, in parts: each task jumps to its own place of the one stream.

A bounded whole number below 2**32 is drawn from 32 bits at a time, the low half of a 64-bit number first, by a product whose high half is the draw; a few
products are rejected and drawn again. So where a draw stands in the stream depends on the rejections before it: a first pass counts
them by chunk of the stream, a second gives every accepted product its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # 64-bit numbers of the stream that a row of work covers


def _accepted(seed: list[int] | int, chunk: int, size: int, high: int) -> np.ndarray:
    """The draws below ``high`` that one chunk of the stream gives."""
    raw = np.random.PCG64(np.random.SeedSequence(seed)).advance(chunk * size).random_raw(size)
    product = np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], axis=1).ravel() * np.uint64(high)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % high)].astype(np.int64)


SLICE = 1 << 16  # draws that leave a task at once


def streams(spark: SparkSession, asked: list[tuple[list[int] | int, int, int]], chunk: int = CHUNK) -> DataFrame:
    """(stream, i, value): what ``numpy.random.default_rng(seed).integers(0, high, n)`` gives for each of asked (seed, high, n), i from 0, all in one run of tasks."""
    if any(not 0 < high < 1 << 32 for _, high, _ in asked):
        raise ValueError("high must be positive and below 2**32")
    # one possible value takes nothing from the stream; else the stream's chunks until they hold n draws: further rounds are as rare as the rejections are many
    want = {k: -(-n // (2 * chunk)) + 1 for k, (_, high, n) in enumerate(asked) if high > 1 and n}
    held: dict[tuple[int, int], int] = {}

    def work(places: list[tuple[int, int]]) -> DataFrame:
        rows = pa.table({"stream": pa.array([p[0] for p in places], pa.int64()), "chunk": pa.array([p[1] for p in places], pa.int64())})
        return spark.createDataFrame(rows).repartition(max(1, min(len(places), 10_000)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(_accepted(asked[k][0], c, chunk, asked[k][1])) for k, c in at], pa.int64())], ["stream", "chunk", "n"])

    while new := [(k, c) for k, m in want.items() for c in range(m) if (k, c) not in held]:
        held |= {(r["stream"], r["chunk"]): r["n"] for r in work(new).mapInArrow(count, "stream long, chunk long, n long").collect()}  # a row for each chunk
        want = {k: m if sum(held[k, c] for c in range(m)) >= asked[k][2] else 2 * m for k, m in want.items()}
    begin = {k: np.concatenate([[0], np.cumsum([held[k, c] for c in range(m)])]) for k, m in want.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = int(begin[k][c])
                value = _accepted(asked[k][0], c, chunk, asked[k][1])[: max(0, asked[k][2] - first)]
                for lo in range(0, len(value), SLICE):
                    part = value[lo : lo + SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k)), pa.array(first + lo + np.arange(len(part))), pa.array(part)], ["stream", "i", "value"])

    out = work([(k, c) for k, m in want.items() for c in range(m)]).mapInArrow(draw, "stream long, i long, value long")
    for k, (_, high, n) in enumerate(asked):
        if high == 1 and n:
            out = out.unionByName(spark.range(n).select(F.lit(k).cast("long").alias("stream"), F.col("id").alias("i"), F.lit(0).cast("long").alias("value")))
    return out


def integers(spark: SparkSession, seed: list[int] | int, high: int, n: int, chunk: int = CHUNK) -> DataFrame:
    """(i, value): what ``numpy.random.default_rng(seed).integers(0, high, n)`` gives, i from 0."""
    return streams(spark, [(seed, high, n)], chunk).select("i", "value")


def boot_weights_by(scenes: DataFrame, seeds: list[list[int] | int], replicates: int) -> DataFrame:
    """(stream, b, scene_id, w): how often each scene of each of several sets is drawn in each replicate of its set.

    scenes: (stream, i, scene_id), i from 0 within a stream; stream k draws as ``integers(0, n, (replicates, n))`` of the generator of
    seeds[k]. One count and one sorted join serve all sets, so nothing that grows with the scenes is broadcast.
    """
    size = {r["stream"]: r["n"] for r in scenes.groupBy("stream").agg(F.count("*").alias("n")).collect()}  # a row for each set
    drawn = streams(scenes.sparkSession, [(seed, size.get(k, 1), replicates * size.get(k, 0)) for k, seed in enumerate(seeds)])
    n = F.element_at(F.create_map(*(F.lit(v).cast("long") for k, m in size.items() for v in (k, m))), F.col("stream")) if size else F.lit(1).cast("long")
    counted = drawn.withColumn("_n", n).groupBy("stream", F.expr("i div _n").alias("b"), F.col("value").alias("i")).agg(F.count("*").alias("w"))
    return counted.join(scenes.select("stream", "i", "scene_id").hint("merge"), ["stream", "i"]).select("stream", "b", "scene_id", "w")


def boot_weights(scenes: DataFrame, seed: list[int] | int, replicates: int) -> DataFrame:
    """(b, scene_id, w): how often each of scenes (i, scene_id; i from 0) is drawn in each replicate, as ``integers(0, n, (replicates, n))`` of the generator draws them."""
    return boot_weights_by(scenes.select(F.lit(0).cast("long").alias("stream"), "i", "scene_id"), [seed], replicates).drop("stream")


def permutations(spark: SparkSession, items: list, seed: int, chains: int) -> DataFrame:
    """(r, pos, item): chain r is ``default_rng(seed + r).permutation`` of the items, a short list."""
    rows = [(r, pos, items[j]) for r in range(chains) for pos, j in enumerate(np.random.default_rng(seed + r).permutation(len(items)).tolist())]
    return spark.createDataFrame(pa.table({"r": [x[0] for x in rows], "pos": [x[1] for x in rows], "item": [x[2] for x in rows]}))
