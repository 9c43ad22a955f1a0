"""Masks as runs by scene: areas, shared pixels, nesting and the cut of the forest, without decoding.

A scene's masks are one bounded group. Rows: (scene_id, mask_no, starts, ends), the runs of ``functions.runs`` in a frame of one height.
Masks that are known by less than their runs (boxes, say) come with ``Shape``, which makes the runs inside the kernel that needs them:
then only what it reads is shuffled.

Defined results: null runs are an empty mask; empty masks share nothing and are in no pair; masks of equal area are never nested.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as U
from .kernel import per_group

PAIRS = "scene_id long, i long, k long, v long, area_i long, area_k long"
AT_ONCE = 1 << 20  # pairs of masks, or runs of such pairs, that are looked at together


class Shape(NamedTuple):
    """make: columns of some rows of a scene to (runs of each row, starts, ends), as one mask after another; height: that of the frame, if all scenes have one."""

    columns: tuple[str, ...]
    make: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    height: int | None = None


def _held(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.asarray(v, np.int64) for v in x[c] if v is not None)])
    return np.array([len(v) if v is not None else 0 for v in x["starts"]], np.int64), flat("starts"), flat("ends")


RUNS = Shape(("starts", "ends"), _held)


def _sorted(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows by mask_no."""
    order = np.argsort(x["mask_no"], kind="stable")
    return {c: v[order] for c, v in x.items()}


def shared(masks: DataFrame, shape: Shape = RUNS) -> DataFrame:
    """(scene_id, i, k, v, area_i, area_k), i < k: pairs of masks that share v pixels. Only pairs whose ranges of positions (and of rows, where the height is known) meet are looked at."""

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = _sorted(x)
        no, own = x["mask_no"].astype(np.int64), U.Flat(*shape.make(x))
        n = len(no)
        top, end = own.rows(shape.height) if shape.height else (np.zeros(n, np.int64), np.ones(n, np.int64))
        out = [[np.zeros(0, np.int64)] * 3]
        step = max(1, AT_ONCE // n)
        for at in range(0, n, step):
            b = slice(at, at + step)
            meet = (own.lo[b, None] < own.hi) & (own.hi[b, None] > own.lo) & (top[b, None] < end) & (end[b, None] > top) & (own.area[b, None] > 0) & (own.area > 0)
            i, k = np.nonzero(np.triu(meet, at + 1))
            i = i + at
            runs = np.cumsum(np.diff(own.first)[k]) if len(k) else np.zeros(0, np.int64)
            edge = [0, *np.searchsorted(runs, np.arange(AT_ONCE, runs[-1], AT_ONCE), "right").tolist(), len(k)] if len(k) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if lo < hi:
                    v = own.shared(i[lo:hi], k[lo:hi])
                    out.append([c[v > 0] for c in (i[lo:hi], k[lo:hi], v)])
        i, k, v = (np.concatenate(c) for c in zip(*out, strict=True))
        return {"scene_id": np.full(len(i), x["scene_id"][0]), "i": no[i], "k": no[k], "v": v, "area_i": own.area[i], "area_k": own.area[k]}

    return per_group(masks.select("scene_id", "mask_no", *shape.columns), "scene_id", solve, PAIRS)


def crossings(masks: DataFrame, theta: tuple[int, int] = (9, 10), shape: Shape = RUNS) -> DataFrame:
    """Pairs of ``shared`` where neither mask lies in the other at ``theta`` of its area: they cross."""
    return shared(masks, shape).filter(f"{theta[1]} * v < {theta[0]} * least(area_i, area_k)")


def coverage(masks: DataFrame, shape: Shape = RUNS) -> DataFrame:
    """(scene_id, masks, total, covered, twice): pixels of all masks of a scene, those that any covers, those that two or more cover."""

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, starts, ends = shape.make(x)
        row = (x["scene_id"][0], len(n), int((ends - starts).sum()), *U.depths(starts, ends))
        return {n: np.array([v]) for n, v in zip(("scene_id", "masks", "total", "covered", "twice"), row, strict=True)}

    return per_group(masks.select("scene_id", "mask_no", *shape.columns), "scene_id", solve, "scene_id long, masks long, total long, covered long, twice long")


def nested(masks: DataFrame, theta: tuple[int, int] = (9, 10), shape: Shape = RUNS) -> DataFrame:
    """Edges (scene_id, a, b, v, area_a, area_b), as ``nesting.nested`` has them of boxes: a lies in b at ``theta`` of a's area and is strictly smaller."""
    p = shared(masks, shape).filter("area_i <> area_k")
    small = "CASE WHEN area_i < area_k THEN {} ELSE {} END AS {}"
    e = p.selectExpr("scene_id", small.format("i", "k", "a"), small.format("k", "i", "b"), "v", "least(area_i, area_k) AS area_a", "greatest(area_i, area_k) AS area_b")
    return e.filter(f"{theta[1]} * v >= {theta[0]} * area_a")


def split(masks: DataFrame, parents: DataFrame, share: float = 0.5, shape: Shape = RUNS) -> DataFrame:
    """(scene_id, mask_no): top-down cut of the forest (scene_id, mask_no, parent): a mask gives way to two or more children that cover ``share`` of it.

    Masks and parents meet in the kernel of their scene; only families of two or more children get their runs.
    """

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        said = x["is_edge"].astype(bool)
        up = dict(zip(x["mask_no"][said].tolist(), x["parent"][said].astype(np.int64).tolist(), strict=True))
        x = _sorted({c: v[~said] for c, v in x.items()})
        no = x["mask_no"].tolist()
        kids: dict[int | None, list[int]] = {}
        for j, m in enumerate(no):
            kids.setdefault(up.get(m), []).append(j)
        family = {m: kids[m] for m in no if len(kids.get(m, [])) >= 2}
        need = np.array([j for j, m in enumerate(no) if m in family or up.get(m) in family], np.int64)
        own = U.Flat(*shape.make({c: x[c][need] for c in shape.columns}))
        at = dict(zip(need.tolist(), range(len(need)), strict=True))
        keep, todo = [], list(kids.get(None, []))
        while todo:
            j = todo.pop()
            under = family.get(no[j], [])
            if under and U.area(U.covered([U.covered([own.one(at[c]) for c in under], 1), own.one(at[j])], 2)) >= share * own.area[at[j]]:
                todo += under
            else:
                keep.append(no[j])
        return {"scene_id": np.full(len(keep), x["scene_id"][0] if len(no) else 0), "mask_no": np.sort(np.array(keep, np.int64))}

    own = masks.select("scene_id", "mask_no", *shape.columns).withColumn("is_edge", F.lit(False))
    edges = parents.select("scene_id", "mask_no", "parent").withColumn("is_edge", F.lit(True))
    return per_group(own.unionByName(edges, allowMissingColumns=True), "scene_id", solve, "scene_id long, mask_no long")
