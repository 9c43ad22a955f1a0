"""Nesting graph of masks and selection on it. Comparisons are in whole numbers: 10 v >= 9 small, 5 a >= 4 b.

Defined results: masks of equal area are never nested; empty boxes overlap nothing; masks with null coordinates
have no edges; (scene_id, mask_no) is a key; ties go to the smaller number; scenes without masks give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import runs as U
from ..plans.cut import cut
from .boxes import area, inter, overlap
from .kernel import ROWS_TOGETHER, expanded, pairs_within, per_group, places

BOX = ("x0", "y0", "x1", "y1")


def nested(masks: DataFrame) -> DataFrame:
    """Edges (scene_id, a, b): a lies in b at 9/10 of a's area and is strictly smaller. Not transitive."""
    on = (F.col("m.scene_id") == F.col("n.scene_id")) & overlap("m", "n")
    e = masks.alias("m").join(masks.alias("n"), on & (F.col("m.mask_no") != F.col("n.mask_no")))
    e = e.select("m.scene_id", F.col("m.mask_no").alias("a"), F.col("n.mask_no").alias("b"), inter("m", "n").cast("long").alias("v"), area("m").cast("long").alias("area_a"), area("n").cast("long").alias("area_b"))
    return e.filter("area_a < area_b AND 10 * v >= 9 * area_a")


def near_duplicates(edges: DataFrame, ratio: tuple[int, int] = (4, 5)) -> DataFrame:
    """Nested pairs of almost one size: area_a / area_b >= ratio, in whole numbers."""
    return edges.filter(f"{ratio[1]} * area_a >= {ratio[0]} * area_b")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    parent = {x: x for x in sorted({*pdf["a"], *pdf["b"]})}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "mask_no": nodes, "comp": [find(x) for x in nodes]})


def select(masks: DataFrame, ratio: tuple[int, int] = (4, 5)) -> DataFrame:
    """One mask per object (scene_id, mask_no), with near-duplicates from a share of areas of ``ratio``.

    Near-duplicates form components; a component survives if every container of
    its members belongs to it; its smallest (area, mask_no) is kept. Components
    are found per scene, a bounded group; all else is joins.
    """
    edges = nested(masks)
    comp = near_duplicates(edges, ratio).select("scene_id", "a", "b").groupBy("scene_id").applyInPandas(_components, "scene_id long, mask_no long, comp long")
    named = masks.alias("x").join(comp, ["scene_id", "mask_no"], "left").select("scene_id", "mask_no", area("x").alias("area"), F.coalesce("comp", "mask_no").alias("comp"))
    own = named.select("scene_id", F.col("mask_no").alias("a"), F.col("comp").alias("comp_a"))
    host = named.select("scene_id", F.col("mask_no").alias("b"), F.col("comp").alias("comp_b"))
    out = edges.select("scene_id", "a", "b").join(own, ["scene_id", "a"]).join(host, ["scene_id", "b"]).filter("comp_a <> comp_b")
    bad = out.select("scene_id", F.col("comp_a").alias("comp")).distinct()
    w = Window.partitionBy("scene_id", "comp").orderBy("area", "mask_no")
    return named.join(bad, ["scene_id", "comp"], "left_anti").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("scene_id", "mask_no")


def _near(scene: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a scene whose sides may meet: the second begins before the first ends, and not further before it than the widest is wide. Some pairs more cost nothing but time."""
    use = np.flatnonzero(~np.isnan(x0) & ~np.isnan(x1))
    if not len(use) or not np.isfinite(np.concatenate([x0[use], x1[use]])).all():
        yield from pairs_within(scene, scene)
        return
    use = use[np.lexsort((x0[use], scene[use]))]
    s, a, b = scene[use].astype(float), x0[use] - x0[use].min(), x1[use] - x0[use].min()
    wide = max(float((b - a).max()), 0.0)
    span = float(max(a.max(), b.max())) + wide + 1
    slack = 1e-9 * span * (s.max() + 2)
    key = s * span + a
    first, last = np.searchsorted(s, s), np.searchsorted(s, s, "right")
    low = np.maximum(np.searchsorted(key, key - wide - slack), first)
    many = np.maximum(np.minimum(np.searchsorted(key, s * span + b + slack, "right"), last) - low, 0)
    for i, j in expanded(low, many):
        yield use[i], use[j]


def _edges(scene: np.ndarray, mask_no: np.ndarray, box: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of ``nested`` among the masks of some scenes."""
    x0, y0, x1, y1 = (np.ascontiguousarray(c) for c in box.T)
    made = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _near(scene, x0, x1):
        for less, more in ((x0, x1), (y0, y1)):
            near = (less[i] < more[j]) & (less[j] < more[i])
            i, j = i[near], j[near]
        v = ((np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])) * (np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j]))).astype(np.int64)
        own = (whole[i] < whole[j]) & (10 * v >= 9 * whole[i]) & (mask_no[i] != mask_no[j])
        made.append((i[own], j[own]))
    i, j = (np.concatenate(c) for c in zip(*made, strict=True))
    return i, j


def chosen_of(mask_no: np.ndarray, box: np.ndarray, ratio: tuple[int, int] = (4, 5), scene: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(selected, maximal) of the masks of one scene, or of several by ``scene``: ``select`` and ``maximal`` as flags."""
    lo, hi = box[:, :2], box[:, 2:]
    with np.errstate(invalid="ignore"):
        area = (hi - lo).prod(axis=1)
        whole = np.where(np.isfinite(area), area, 0).astype(np.int64)
    i, j = _edges(np.zeros(len(mask_no), np.int64) if scene is None else scene, mask_no, box, whole)
    near = ratio[1] * whole[i] >= ratio[0] * whole[j]
    comp = np.arange(len(mask_no))
    while True:  # the smallest place spreads over near-duplicates
        was = comp.copy()
        np.minimum.at(comp, i[near], was[j[near]])
        np.minimum.at(comp, j[near], was[i[near]])
        comp = comp[comp]
        if (comp == was).all():
            break
    good = np.ones(len(mask_no), bool)
    good[comp[i[comp[i] != comp[j]]]] = False
    order = np.lexsort((mask_no, area, comp))
    first = order[np.concatenate([np.ones(min(len(order), 1), bool), np.diff(comp[order]) != 0])]
    selected, maximal_ = np.zeros(len(mask_no), bool), np.ones(len(mask_no), bool)
    selected[first] = good[comp[first]]
    maximal_[i] = False
    return selected, maximal_


def found(gt: DataFrame, masks: DataFrame, least: float = 0.5) -> DataFrame:
    """(scene_id, den, every, rho, top): ground truth, and how much of it has an IoU of ``least`` with any mask, a selected one and a maximal one. A scene is read once, and many scenes are solved together."""
    g = gt.select("scene_id", F.lit(True).alias("is_gt"), F.lit(None).cast("long").alias("no"), *(F.col(c).cast("double").alias(c) for c in BOX))
    m = masks.select("scene_id", F.lit(False).alias("is_gt"), F.col("mask_no").cast("long").alias("no"), *(F.col(c).cast("double").alias(c) for c in BOX))

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        is_gt, scene = x["is_gt"].astype(bool), places(x["scene_id"])
        box = np.stack([x[c] for c in BOX], axis=1).astype(float)
        g, m, own, of = box[is_gt], box[~is_gt], scene[is_gt], scene[~is_gt]
        selected, top = chosen_of(x["no"][~is_gt].astype(np.int64), m, scene=of)
        size = lambda z: (z[:, 2] - z[:, 0]) * (z[:, 3] - z[:, 1])
        ga, ma, hit = size(g), size(m), np.zeros((3, len(g)), bool)
        for i, j in pairs_within(own, of):
            near = (np.maximum(g[i, :2], m[j, :2]) < np.minimum(g[i, 2:], m[j, 2:])).all(axis=1)
            i, j = i[near], j[near]
            both = (np.minimum(g[i, 2:], m[j, 2:]) - np.maximum(g[i, :2], m[j, :2])).prod(axis=1)
            union = ga[i] + ma[j] - both
            good = np.divide(both, union, out=np.zeros_like(both), where=union != 0) >= least
            i, j = i[good], j[good]
            for k, flags in enumerate((np.ones(len(m), bool), selected, top)):
                hit[k, i[flags[j]]] = True
        first = np.flatnonzero(np.diff(scene, prepend=-1))
        den = np.bincount(own, minlength=len(first))
        every, rho, best = (np.bincount(own, weights=h, minlength=len(first)).astype(np.int64)[den > 0] for h in hit)
        return {"scene_id": x["scene_id"][first][den > 0], "den": den[den > 0], "every": every, "rho": rho, "top": best}

    return per_group(g.unionByName(m), "scene_id", solve, "scene_id long, den long, every long, rho long, top long", ROWS_TOGETHER)


def record(masks: DataFrame) -> DataFrame:
    """Counters of ``select`` by scene: masks, selected, nested and near-duplicate pairs, groups, nested pairs of equal area."""
    edges = nested(masks)
    kept, e = cut(select(masks)), cut(edges)
    pair = near_duplicates(e).select("scene_id", "a", "b").groupBy("scene_id").applyInPandas(_components, "scene_id long, mask_no long, comp long")
    joined = pair.groupBy("scene_id").agg((F.count("*") - F.count_distinct("comp")).alias("_less"))
    on = (F.col("m.scene_id") == F.col("n.scene_id")) & (F.col("m.mask_no") < F.col("n.mask_no")) & overlap("m", "n")
    same = masks.alias("m").join(masks.alias("n"), on).filter((area("m") == area("n")) & (10 * inter("m", "n") >= 9 * area("m"))).groupBy("m.scene_id").agg(F.count("*").alias("equal_area"))
    n = masks.groupBy("scene_id").agg(F.count("*").alias("masks"))
    out = n.join(kept.groupBy("scene_id").agg(F.count("*").alias("selected")), "scene_id", "left")
    out = out.join(e.groupBy("scene_id").agg(F.count("*").alias("nested_pairs"), F.count_if(F.expr("5 * area_a >= 4 * area_b")).alias("near_pairs")), "scene_id", "left")
    out = out.join(joined, "scene_id", "left").join(same, "scene_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("scene_id", "masks", zero("selected"), zero("nested_pairs"), zero("near_pairs"), (F.col("masks") - F.coalesce("_less", F.lit(0))).alias("groups"), zero("equal_area"))


def violations(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Selected pairs that are still nested: none, for a correct selection."""
    a = selected.select("scene_id", F.col("mask_no").alias("a"))
    b = selected.select("scene_id", F.col("mask_no").alias("b"))
    return edges.join(a, ["scene_id", "a"], "left_semi").join(b, ["scene_id", "b"], "left_semi").select("scene_id", "a", "b")


def chain_max(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """Masks that no comparable mask beats by a larger score, or an equal one and a smaller number."""
    both = edges.select("scene_id", "a", "b").union(edges.select("scene_id", F.col("b"), F.col("a")))
    s = masks.select("scene_id", "mask_no", "score")
    me = s.select("scene_id", F.col("mask_no").alias("a"), F.col("score").alias("sa"))
    other = s.select("scene_id", F.col("mask_no").alias("b"), F.col("score").alias("sb"))
    beaten = both.join(me, ["scene_id", "a"]).join(other, ["scene_id", "b"]).filter("sb > sa OR (sb = sa AND b < a)")
    return masks.join(beaten.select("scene_id", F.col("a").alias("mask_no")).distinct(), ["scene_id", "mask_no"], "left_anti").select("scene_id", "mask_no")


def maximal(masks: DataFrame, edges: DataFrame) -> DataFrame:
    return masks.join(edges.select("scene_id", F.col("a").alias("mask_no")).distinct(), ["scene_id", "mask_no"], "left_anti").select("scene_id", "mask_no")


def minimal(masks: DataFrame, edges: DataFrame) -> DataFrame:
    return masks.join(edges.select("scene_id", F.col("b").alias("mask_no")).distinct(), ["scene_id", "mask_no"], "left_anti").select("scene_id", "mask_no")


def parents(edges: DataFrame) -> DataFrame:
    """The smallest container of each nested mask (area, then number)."""
    w = Window.partitionBy("scene_id", "a").orderBy("area_b", "b")
    return edges.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("scene_id", F.col("a").alias("mask_no"), F.col("b").alias("parent"))


def positions(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """isolated, root, leaf or internal, by whether a mask has a parent and children."""
    up = parents(edges)
    kids = up.select("scene_id", F.col("parent").alias("mask_no")).distinct().withColumn("kid", F.lit(1))
    p = masks.select("scene_id", "mask_no").join(up, ["scene_id", "mask_no"], "left").join(kids, ["scene_id", "mask_no"], "left")
    kind = F.when(F.col("parent").isNull() & F.col("kid").isNull(), "isolated").when(F.col("parent").isNull(), "root").when(F.col("kid").isNull(), "leaf").otherwise("internal")
    return p.select("scene_id", "mask_no", kind.alias("position"))


def intransitive(edges: DataFrame) -> DataFrame:
    """Triples a in b in c where a is not in c."""
    e = edges.select("scene_id", "a", "b")
    two = e.alias("p").join(e.alias("q"), (F.col("p.scene_id") == F.col("q.scene_id")) & (F.col("p.b") == F.col("q.a"))).select("p.scene_id", "p.a", F.col("p.b").alias("m"), F.col("q.b").alias("b"))
    return two.join(e, ["scene_id", "a", "b"], "left_anti")


def _depths(pdf: pd.DataFrame) -> pd.DataFrame:
    up = dict(zip(pdf["mask_no"], pdf["parent"], strict=True))
    rows = []
    for x in up:
        d, y = 0, x
        while y in up:
            d, y = d + 1, up[y]
        rows.append((x, d, y))
    return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "mask_no": [r[0] for r in rows], "depth": [r[1] for r in rows], "root": [r[2] for r in rows]})


def depths(edges: DataFrame) -> DataFrame:
    """Depth and root of every mask that has a parent; scenes are bounded groups."""
    return parents(edges).groupBy("scene_id").applyInPandas(_depths, "scene_id long, mask_no long, depth long, root long")


def _closure(pdf: pd.DataFrame) -> pd.DataFrame:
    up = dict(zip(pdf["mask_no"], pdf["parent"], strict=True))
    rows = []
    for x in up:
        g, y = 0, x
        while y in up:
            g, y = g + 1, up[y]
            rows.append((x, y, g))
    return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "mask_no": [r[0] for r in rows], "ancestor": [r[1] for r in rows], "generation": [r[2] for r in rows]})


def ancestors(edges: DataFrame) -> DataFrame:
    return parents(edges).groupBy("scene_id").applyInPandas(_closure, "scene_id long, mask_no long, ancestor long, generation long")


def matching_width(n: int, edges: list[tuple[int, int]]) -> int:
    """Largest antichain of a relation on n items: n less the maximum matching of its closure (Dilworth), by Hopcroft and Karp without recursion."""
    reach = np.zeros((n, n), dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, k, None] & reach[None, k, :]
    to = [np.flatnonzero(reach[a]).tolist() for a in range(n)]
    left, right = [-1] * n, [-1] * n
    while True:
        far = {a: 0 for a in range(n) if left[a] < 0}  # steps from a free item, breadth first
        queue, found = list(far), False
        for a in queue:
            for b in to[a]:
                if right[b] < 0:
                    found = True
                elif right[b] not in far:
                    far[right[b]] = far[a] + 1
                    queue.append(right[b])
        if not found:
            return n - sum(x >= 0 for x in left)
        at = [0] * n  # next choice of each item: none is tried twice in a round
        for start in [a for a in range(n) if left[a] < 0]:
            path = [start]
            while path:
                a = path[-1]
                if at[a] == len(to[a]):
                    path.pop()
                    continue
                b = to[a][at[a]]
                at[a] += 1
                if right[b] < 0:
                    for a in reversed(path):  # each item takes the choice it is at; the one before it gives that up
                        b = to[a][at[a] - 1]
                        left[a], right[b] = b, a
                    break
                if far.get(right[b]) == far[a] + 1:
                    path.append(right[b])


def _width(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = sorted({*pdf["a"], *pdf["b"]})
    at = {x: i for i, x in enumerate(nodes)}
    w = matching_width(len(nodes), [(at[a], at[b]) for a, b in zip(pdf["a"], pdf["b"], strict=True)])
    return pd.DataFrame({"scene_id": [pdf["scene_id"].iloc[0]], "nested": [len(nodes)], "antichain": [w]})


def widths(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """Width of each scene's order: masks outside any pair count one each."""
    w = edges.select("scene_id", "a", "b").groupBy("scene_id").applyInPandas(_width, "scene_id long, nested long, antichain long")
    n = masks.groupBy("scene_id").agg(F.count("*").alias("n"))
    return n.join(w, "scene_id", "left").select("scene_id", (F.col("n") - F.coalesce("nested", F.lit(0)) + F.coalesce("antichain", F.lit(0))).alias("width"))


def box_shape(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of whole pixels as runs, in a frame that holds all these boxes; boxes with null coordinates are empty."""
    box = np.stack([np.asarray(x[c], float) for c in ("x0", "y0", "x1", "y1")], axis=1)
    box = np.where(np.isfinite(box).all(axis=1)[:, None], box, 0).astype(np.int64)
    y = int(box[:, 1].min()) if len(box) else 0
    h = int(box[:, 3].max()) - y if len(box) else 0
    return U.from_boxes(box - np.array([0, y, 0, y]), h)


def box_runs(masks: DataFrame) -> DataFrame:
    """Boxes of whole pixels as masks of runs: scene_id, mask_no, starts, ends in a frame that holds all boxes of the scene."""

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, a, b = box_shape(x)
        edge = np.cumsum(n)[:-1]
        starts, ends = np.empty(len(n), object), np.empty(len(n), object)
        starts[:], ends[:] = np.split(a, edge), np.split(b, edge)
        return {"scene_id": x["scene_id"], "mask_no": x["mask_no"], "starts": starts, "ends": ends}

    sound = masks.select("scene_id", "mask_no", "x0", "y0", "x1", "y1").na.drop()
    return per_group(sound, "scene_id", solve, "scene_id long, mask_no long, starts array<long>, ends array<long>")


def split(masks: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """Top-down cut of the forest: a mask gives way to two or more children that cover ``share`` of it; then masks nested in another one kept go."""
    from . import masks as K

    edges = cut(edges.select("scene_id", "a", "b", "area_b"))
    sound = masks.select("scene_id", "mask_no", *BOX).na.drop()
    member = cut(edges.select("scene_id", F.col("a").alias("mask_no")).union(edges.select("scene_id", F.col("b"))).distinct())  # all others are kept
    kept = cut(K.split(sound.join(member, ["scene_id", "mask_no"], "left_semi"), parents(edges), share, K.Shape(BOX, box_shape)))
    inner = violations(kept, edges).select("scene_id", F.col("a").alias("mask_no")).distinct()
    gone = member.join(kept.join(inner, ["scene_id", "mask_no"], "left_anti"), ["scene_id", "mask_no"], "left_anti")
    return sound.select("scene_id", "mask_no").join(gone, ["scene_id", "mask_no"], "left_anti")
