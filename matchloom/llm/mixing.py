"""Mixing sources to target weights by cube-method balanced sampling.

A source of size S with target T takes every document floor(T / S) times and
one time more with probability pi = T / S - floor(T / S).  Which documents take
the extra time is drawn by the cube method: the vector of probabilities moves
along the null space of the balancing constraints (tokens and documents of the
source), each move fixing at least one document at 0 or 1, so both totals stay
exact until fewer units than constraints are left.  Those few, with up to ``RESERVE``
documents of usual size per source that were kept for it, are the landing problem: of all
ways to round them, the one that comes nearest to what the source is owed.

Equal rows (source, doc_id, size) are one unit with a number of copies c: floor(c pi) of
them take the extra time for certain, and one more with the rest as its probability, so repeats, however
many, are a row of the flight.

The flight is run in blocks of about ``block`` documents by a hash of the id,
then over what is left of groups of blocks, then over what is left of each
source: every level leaves two units per group at most, so no task sees a whole
source, however hot.  Draws come from hashes of (source, level, group), so reruns agree.

Defined results: null texts have size 0; documents of size 0 take no words;
a null source is a source of its own, weighed last; repeated rows are documents of
their own, and of equal ones any may take the extra time; an empty table gives an empty
result; other columns are ignored.  Targets are computed over one row per source in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stash as S

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target of (source, size) rows.

    Weights repeat over the sources by code point, null last.  A target is
    min(most * S, level * weight), the level at which all targets add up to all
    sizes; that is where resharing the excess by weight ends.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("full", F.col("source_size") * most / F.col("w"))
    rise = Window.orderBy("full", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    below = rise.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (F.sum("source_size").over(all_) - most * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    # sources fill up in the order of `full`; the first whose level is not above its own `full` ends the resharing
    by = by.withColumn("end", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(all_)["level"])
    return by.select("source", "source_size", F.least(F.col("source_size") * most, F.coalesce(F.col("end"), F.col("full")) * F.col("w")).alias("target"))


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves pi along the null space of the rows of x / pi until at most len(x) units are open."""
    p = pi.astype(float).copy()
    a = x / np.where(pi > 0, pi, 1)[None, :]
    m = len(a)
    todo = iter(np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)).tolist())
    active: list[int] = []
    while True:
        while len(active) <= m:
            nxt = next(todo, None)
            if nxt is None:
                return p
            active.append(nxt)
        if m == 2:  # the null space of two rows and three units is their cross product
            (a0, a1, a2), (b0, b1, b2) = a[0, active], a[1, active]
            u = np.array([a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0])
            if not np.abs(u).max() > 1e-12 * max(1.0, abs(a0) + abs(a1) + abs(a2)):
                u = np.linalg.svd(a[:, active])[2][-1]
        else:
            u = np.linalg.svd(a[:, active])[2][-1]
        q = p[active]
        u = u / np.abs(u).max()
        u[np.abs(u) < 1e-12] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        q = q + (up * u if rng.random() * (up + down) < down else -down * u)
        p[active] = np.clip(q, 0, 1)
        active = [i for i in active if 1e-9 < p[i] < 1 - 1e-9]


RESERVE = 14
PIECE = 4096  # copies of a unit that are written out at once


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the open units: of all 0-1 choices the one whose tokens, then documents, come nearest to the open totals."""
    p = p.copy()
    at = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(at) > RESERVE + 4:  # numerically stuck units: the largest are rounded alone
        at = at[np.argsort(-size[at], kind="stable")]
        early, at = at[: -(RESERVE + 4)], at[-(RESERVE + 4) :]
        owed = 0.0
        for i in early:
            take = float(abs(owed + p[i] * size[i] - size[i]) <= abs(owed + p[i] * size[i]))
            owed += (p[i] - take) * size[i]
            p[i] = take
    else:
        owed = 0.0
    tokens, number = np.zeros(1), np.zeros(1)
    for i in at:
        tokens, number = np.concatenate([tokens, tokens + size[i]]), np.concatenate([number, number + 1])
    off = np.abs(tokens - (p[at] * size[at]).sum() - owed) + 0.05 * size[at].mean() * np.abs(number - p[at].sum()) if len(at) else np.zeros(1)
    p[at] = int(off.argmin()) >> np.arange(len(at)) & 1
    return np.round(p)


def _level(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # an order of content, not of arrival
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable").reset_index(drop=True)
        source, group = pdf["source"].iloc[0], int(pdf["g"].iloc[0])
        rng = np.random.default_rng([level, group, zlib.crc32(("" if pd.isna(source) else f"s{source}").encode())])
        pi, size = pdf["pi"].to_numpy(), pdf["size"].to_numpy().astype(float)
        late = pdf["late"].to_numpy().astype(bool)
        if level == 1 and group == 0:  # some documents of usual sizes wait for the landing
            usual = np.flatnonzero((pi > 0) & (pi < 1) & (size > 0))
            usual = usual[size[usual] <= np.quantile(size[usual], 0.75)] if len(usual) else usual
            late = late.copy()
            late[usual[: min(RESERVE, len(pdf) // 5)]] = True
        p = pi.astype(float).copy()
        p[~late] = flight(pi[~late], np.stack([size * pi, pi])[:, ~late], rng)  # a = size and 1: token and document totals
        pdf["pi"] = land(p, size) if level == 3 else np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
        pdf["late"] = late
        return pdf

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = 4096, groups: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of (doc_id, source, text)."""
    sizes = S.stash(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    goal = targets(sizes, weights, most)
    number = sizes.groupBy("source").agg(F.count("*").alias("n"))
    goal = S.stash(goal.join(number, goal["source"].eqNullSafe(number["source"])).drop(number["source"]), "targets")  # a row per source
    t, s = goal.alias("t"), sizes.alias("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    same = s.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")).alias("s")
    share = F.greatest(ratio - F.floor(ratio + 1e-12), F.lit(0.0)) * F.col("copies")
    units = same.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.doc_id", "s.source", "s.size", "source_size", "target", "copies",
        F.floor(ratio + 1e-12).cast("long").alias("times"),
        F.floor(share + 1e-9).cast("long").alias("sure"),
        F.greatest(share - F.floor(share + 1e-9), F.lit(0.0)).alias("pi"),
        F.xxhash64("s.doc_id", "s.size").alias("h"),
        F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long").alias("blocks"),
        F.lit(False).alias("late"),
    )
    schema = "doc_id long, source string, size long, source_size long, target double, copies long, times long, sure long, pi double, h long, blocks long, late boolean, g long"
    open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
    units = units.withColumn("g", F.pmod("h", "blocks"))
    first = S.stash(units.groupBy("source", "g").applyInPandas(_level(1), schema), "flight")
    rest = first.filter(open_).withColumn("g", F.floor(F.col("g") / groups).cast("long"))
    second = S.stash(rest.groupBy("source", "g").applyInPandas(_level(2), schema), "flight")
    third = second.filter(open_).withColumn("g", F.lit(0).cast("long")).groupBy("source", "g").applyInPandas(_level(3), schema)
    S.drop(sizes)
    out = first.filter(~open_).union(second.filter(~open_)).union(third)
    names = ["doc_id", "source", "size", "source_size", "target"]
    extra = F.col("sure") + F.round("pi").cast("long")
    once = out.filter("copies = 1").select(*names, ((F.col("times") + extra) * F.col("size")).cast("long").alias("taken"))
    # repeats are written out piece by piece, the pieces dealt to tasks
    last = ((F.col("copies") - 1) / PIECE).cast("long")
    pieces = out.filter("copies > 1").select(*names, "copies", "times", extra.alias("extra"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).repartition("doc_id", "size", "piece")
    at = F.sequence(F.col("piece") * PIECE + 1, F.least(F.col("copies"), (F.col("piece") + 1) * PIECE))
    many = pieces.select(*names, "times", "extra", F.explode(at).alias("i"))
    return once.union(many.select(*names, ((F.col("times") + (F.col("i") <= F.col("extra")).cast("long")) * F.col("size")).cast("long").alias("taken")))
