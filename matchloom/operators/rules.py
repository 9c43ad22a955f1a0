"""Decision rules over results: holds, chains, majorities, outcomes, choices. All are column expressions or small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def eps_holds(low: Column, eps: float, delta: float) -> Column:
    return low <= eps * (1 + delta)


def chain_verdict(cells: DataFrame, by: list[str], pairs: int = 3) -> DataFrame:
    """A chain holds if all its growth pairs hold and none is missing (cells: by, r, pair, holds)."""
    return cells.groupBy(*by, "r").agg((F.every(F.coalesce("holds", F.lit(False))) & (F.count_distinct("pair") == pairs)).alias("holds"))


def majority(chains: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    return chains.groupBy(*by).agg(F.count_if("holds").alias("chains"), (F.count_if("holds") >= least).alias("majority"))


def outcome(lo: Column, hi: Column) -> Column:
    """1 above zero, 3 below, 2 undecided."""
    return F.when(lo > 0, 1).when(hi < 0, 3).otherwise(2)


def joint(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The common outcome, null if they differ."""
    return df.groupBy(*by).agg(F.when(F.count_distinct(column) == 1, F.max(column)).alias("joint"))


def rejection_outcome(model: Column, quantile: Column, fixed: Column) -> Column:
    """refined: a if the model holds, else b if the recalibrated quantile does, else c; as_written: b and c only where the fixed threshold fails, else null."""
    code = F.when(model, "a").when(quantile, "b").otherwise("c")
    return F.struct(code.alias("refined"), F.when(model | ~fixed, code).alias("as_written"))


def first_run(ap: Column, least: float = 30.0, published: float = 41.61, within: float = 8.0) -> Column:
    return (ap >= least) & (F.abs(ap - published) <= within)


def best_variant(df: DataFrame, tie: float = 0.1) -> DataFrame:
    """Largest ap; within ``tie`` of it the larger ap50, then the earlier ord."""
    top = F.max("ap").over(Window.partitionBy())
    near = df.withColumn("top", top).filter(F.col("ap") >= F.col("top") - tie)
    return near.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("ap50"), "ord"))).filter("rn = 1").drop("rn", "top")


def gallery_check(types: DataFrame) -> DataFrame:
    """Mean top-1 of at least 1/2 and at least four types with 1/3 (types: hit, n), in whole numbers where exact."""
    return types.agg((F.avg(F.col("hit") / F.col("n")) >= 0.5).alias("mean_ok"), (F.count_if(F.col("hit") * 3 >= F.col("n")) >= 4).alias("types_ok")).select("mean_ok", "types_ok", (F.col("mean_ok") & F.col("types_ok")).alias("ok"))


def ap_ceiling(recall: Column) -> Column:
    return F.least(F.lit(1.0), recall + 1 / 101)


def transfer(cells: DataFrame, sizes: tuple[int, ...] = (25, 50, 100), least: int = 5) -> DataFrame:
    """Whether the level holds at each size (cells: n, r, holds): a majority of chains, at the last size all alike, else an error."""
    full = F.col("n") == max(sizes)
    alike = F.when(full & (F.count_distinct("holds") > 1), F.raise_error(F.lit("cells of the full gallery differ")).cast("boolean"))
    return cells.groupBy("n").agg(F.count_if("holds").alias("chains"), F.coalesce(alike, F.when(full, F.every("holds")).otherwise(F.count_if("holds") >= least)).alias("holds"))


def zone_verdict(found: Column, upper: Column, lower: Column, margin: Column | float) -> Column:
    """upper, lower or partial: within the margin of the upper level, of the lower one, or between; null levels give null, overlapping zones an error."""
    hi, lo = upper - margin, lower + margin
    return F.when(lo >= hi, F.raise_error(F.lit("zones overlap")).cast("string")).when(found >= hi, "upper").when(found <= lo, "lower").when(found.isNotNull(), "partial")


def sequential_choice(results: DataFrame, gain: float = 0.01) -> DataFrame:
    """The last candidate that beats the one before it by ``gain`` (results: ord, name, recall), from the first in ord. A few rows, folded in one."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", "recall")))
    fold = F.aggregate("rows", F.col("rows")[0], lambda at, x: F.when(x["recall"] >= at["recall"] + gain, x).otherwise(at))
    return results.agg(rows.alias("rows")).filter(F.size("rows") > 0).select(fold.alias("x")).select("x.name", "x.recall")


def ceiling_check(found: DataFrame, recall: DataFrame) -> DataFrame:
    """type, ap, top, violated: whether ap is above ``ap_ceiling`` of the type's recall; never, for a correct evaluation."""
    return found.join(recall, "type").select("type", "ap", ap_ceiling(F.col("recall")).alias("top")).withColumn("violated", F.col("ap") > F.col("top") + 1e-12)
