"""Descriptive statistics: distributions, rank correlation, two-sample distance, intervals, bootstrap summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import _weights as weight_matrix
from .metrics import average_ranks
from .ranks import quantiles_by


def distribution(df: DataFrame, value: str, by: list[str], edges: list[float]) -> DataFrame:
    """n, mean, min, max, five quantiles and a histogram (last bin closed) of finite values, by group."""
    v = F.col(value)
    x = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    bins = [F.count_if((v >= lo) & ((v < hi) if i < len(edges) - 2 else (v <= hi))) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    q = {f"q{int(p * 100):02d}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    found = quantiles_by(x, value, by, q).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *(F.round(c, 6).alias(c) for c in q))
    moments = x.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"), *(b.alias(f"bin{i}") for i, b in enumerate(bins)))
    return moments.join(F.broadcast(found), [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]).drop(*(f"_k{i}" for i in range(len(by))))  # a row for each group


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks; null for fewer than three rows."""
    r = average_ranks(average_ranks(df, a, "_ra", by), b, "_rb", by)
    return r.groupBy(*by).agg(F.when(F.count("*") >= 3, F.round(F.corr("_ra", "_rb"), 6)).alias("rho"), F.count("*").alias("n"))


def ks(df: DataFrame, value: str, first: Column, by: list[str]) -> DataFrame:
    """Largest distance of two empirical distributions, at their distinct values."""
    g = df.groupBy(*by, value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    run, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    d = F.abs(F.try_divide(F.sum("a").over(run), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(run), F.sum("b").over(whole)))
    return g.withColumn("d", d).groupBy(*by).agg(F.round(F.max("d"), 9).alias("ks"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def interval(v: str) -> list[Column]:
    """95 % percentile interval."""
    return [F.round(F.percentile(v, F.lit(0.025)), 6).alias("lo"), F.round(F.percentile(v, F.lit(0.975)), 6).alias("hi")]


def ratio_bootstrap(scenes: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per replicate the ratio of weighted sums of (scene_id, num, den): not the mean of ratios. ``by``: columns of scenes."""
    j = scenes.join(weights, "scene_id")
    return j.groupBy("b", *(by or [])).agg(F.try_divide(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("value"))


def weighted_sums(scenes: DataFrame, vectors: DataFrame, replicates: int, values: list[str], by: list[str]) -> DataFrame:
    """(by, b, values): sums of whole values of the scenes under the weights (scene_id, wv) of each replicate, by strings ``by``; sums leave a task once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = pa.Table.from_batches([x]).append_column("_at", pa.array(range(x.num_rows), pa.int64()))
            for own in at.group_by(by).aggregate([("_at", "list")]).to_pylist() if by else [{"_at_list": list(range(x.num_rows))}]:
                some = x.take(pa.array(own["_at_list"], pa.int64()))
                w = weight_matrix(np.array(some.column("wv").to_pylist(), object), replicates)
                total = [v.to_numpy().astype(float) @ w for v in (some.column(c) for c in values)]
                yield pa.RecordBatch.from_arrays([*(pa.array([own[c]] * replicates, pa.string()) for c in by), pa.array(range(replicates), pa.int64()), *(pa.array(v.astype(np.int64)) for v in total)], [*by, "b", *values])

    j = scenes.join(vectors.hint("merge"), "scene_id").select(*(F.col(c).cast("string").alias(c) for c in by), *(F.col(c).cast("long").alias(c) for c in values), "wv")
    made = j.mapInArrow(run, ", ".join([*(f"{c} string" for c in by), "b long", *(f"{c} long" for c in values)]))
    return made.groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in values))


def paired(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Replicate-wise difference of two (b, by, value) tables."""
    keys = ["b", *(by or [])]
    return a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), keys).select(*keys, (F.col("va") - F.col("vb")).alias("value"))
