"""Detection metrics: matching, average precision and recall, AUROC, rejection rates.

Defined results: scenes without ground truth match nothing, scenes without detections give no rows;
rows without a scene take no part; null scores come last; repeated detections are detections of their own;
categories without ground truth have no AP, those without detections AP 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.cut import cut, stored
from ..plans.numbering import numbered
from .kernel import ROWS_TOGETHER, pairs_within, per_group, places, streamed

#: IoU and recall thresholds; both are the doubles of numpy.linspace.
IOU_THRESHOLDS = np.linspace(0.5, 0.95, 10)
RECALL_POINTS = np.linspace(0.0, 1.0, 101)

def match_group(det: dict, gt: dict, thresholds: np.ndarray, lo: float, hi: float, max_det: int) -> dict:
    """Columns rank, score, thr, matched, ignored, gt_no of one scene and category (dicts of arrays).

    Detections by falling score meet ground truth with the ignored last; each
    takes the best IoU of at least the threshold, later ones winning ties; a
    matched box is free again only if it is a crowd; a match to an ignored box,
    or no match at an area out of range, makes the detection ignored.
    """
    first = np.lexsort((det["det_no"], -det["score"]))[:max_det]
    d, g = (np.stack([x[c] for c in ("x0", "y0", "x1", "y1")], axis=1).astype(float) for x in (det, gt))
    d, score = d[first], det["score"][first]
    da, ga = (d[:, 2] - d[:, 0]) * (d[:, 3] - d[:, 1]), (g[:, 2] - g[:, 0]) * (g[:, 3] - g[:, 1])
    skip = gt["iscrowd"] | (ga < lo) | (ga > hi)
    order = np.lexsort((gt["gt_no"], skip))
    g, ga, crowd, skip, no = g[order], ga[order], gt["iscrowd"][order], skip[order], gt["gt_no"][order]
    w = np.minimum(d[:, None, 2], g[None, :, 2]) - np.maximum(d[:, None, 0], g[None, :, 0])
    h = np.minimum(d[:, None, 3], g[None, :, 3]) - np.maximum(d[:, None, 1], g[None, :, 1])
    i = np.maximum(w, 0) * np.maximum(h, 0)
    union = np.where(crowd[None, :], da[:, None], da[:, None] + ga[None, :] - i)
    iou = np.divide(i, union, out=np.zeros_like(i), where=union > 0)
    n, t = len(d), len(thresholds)
    match = np.full((t, n), -1)
    rivals = [(r, np.flatnonzero(iou[r] >= thresholds[0] - 1e-9).tolist()) for r in np.flatnonzero((iou >= thresholds[0] - 1e-9).any(axis=1)).tolist()]
    for k, thr in enumerate(thresholds.tolist()):
        taken: set[int] = set()
        for r, near in rivals:
            best, m = min(thr, 1 - 1e-10), -1
            for j in near:
                if j in taken and not crowd[j]:
                    continue
                if m >= 0 and not skip[m] and skip[j]:
                    break
                if iou[r, j] >= best:
                    best, m = iou[r, j], j
            if m >= 0:
                taken.add(m)
                match[k, r] = m
    hit = match >= 0
    ignored = np.where(hit, skip[match] if len(g) else False, ((da < lo) | (da > hi))[None, :])
    return {
        "rank": np.tile(np.arange(n), t), "score": np.tile(score, t), "thr": np.repeat(np.arange(t), n),
        "matched": hit.ravel(), "ignored": ignored.ravel(), "gt_no": np.where(hit, no[match] if len(g) else -1, -1).ravel(),
    }


def _candidates(det: dict, gt: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, IoU) of detections and ground truth of one category with an IoU of ``least`` or more, by i; a crowd divides by the detection alone."""
    found = []
    for i, j in pairs_within(det["cat"], gt["cat"]):
        meet = (det["x0"][i] < gt["x1"][j]) & (gt["x0"][j] < det["x1"][i]) & (det["y0"][i] < gt["y1"][j]) & (gt["y0"][j] < det["y1"][i])
        i, j = i[meet], j[meet]
        d, g = ({c: x[c][k] for c in ("x0", "y0", "x1", "y1")} for x, k in ((det, i), (gt, j)))
        both = np.maximum(np.minimum(d["x1"], g["x1"]) - np.maximum(d["x0"], g["x0"]), 0) * np.maximum(np.minimum(d["y1"], g["y1"]) - np.maximum(d["y0"], g["y0"]), 0)
        da, ga = ((z["x1"] - z["x0"]) * (z["y1"] - z["y0"]) for z in (d, g))
        union = np.where(gt["crowd"][j], da, da + ga - both)
        iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        found.append((i[iou >= least], j[iou >= least], iou[iou >= least]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def match_scene(det: dict, gt: dict, thresholds: np.ndarray, ranges: tuple[tuple[str, float, float], ...]):
    """(range, hits, skips, gt_nos) of detections, which come by category and rank: ``match_group`` for all categories and ranges at once. A category may be one of a scene, so many scenes match together.

    The pairs that can match are found once. A detection whose only candidate has no other one (or is a crowd) needs no turn: whole columns settle those; the
    others take their turns, threshold by threshold.
    """
    n, t = len(det["cat"]), len(thresholds)
    bits = 1 << np.arange(t)
    i, j, iou = _candidates(det, gt, thresholds[0] - 1e-9)
    da, ga = ((z["x1"] - z["x0"]) * (z["y1"] - z["y0"]) for z in (det, gt))
    alone = (np.bincount(i, minlength=n)[i] == 1) & ((np.bincount(j, minlength=len(ga))[j] == 1) | gt["crowd"][j])
    si, sj = i[alone], j[alone]
    reach = np.minimum(thresholds, 1 - 1e-10)
    simple = iou[alone, None] >= reach
    turns: dict[int, list[int]] = {}
    for p in np.flatnonzero(~alone).tolist():
        turns.setdefault(int(i[p]), []).append(p)
    for name, lo, hi in ranges:
        skip = gt["crowd"] | (ga < lo) | (ga > hi)
        match = np.full((n, t), -1)
        match[si] = np.where(simple, sj[:, None], -1)
        if turns:
            place = np.empty(len(ga), np.int64)
            place[np.lexsort((gt["no"], skip))] = np.arange(len(ga))
            near = {r: sorted(((int(j[p]), float(iou[p])) for p in ps), key=lambda c: place[c[0]]) for r, ps in turns.items()}
            for k, thr in enumerate(reach.tolist()):
                taken: set[int] = set()
                for r, some in near.items():
                    best, m = thr, -1
                    for c, v in some:
                        if c in taken and not gt["crowd"][c]:
                            continue
                        if m >= 0 and not skip[m] and skip[c]:
                            break
                        if v >= best:
                            best, m = v, c
                    if m >= 0:
                        taken.add(m)
                        match[r, k] = m
        hit, out = match >= 0, (da < lo) | (da > hi)
        if len(ga):
            yield name, hit @ bits, np.where(hit, skip[match], out[:, None]) @ bits, np.where(hit, gt["no"][match], -1)
        else:
            yield name, hit @ bits, np.repeat(out[:, None], t, axis=1) @ bits, match


def _groups_of(scene: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each scene and category, and the categories, whose place is that number modulo theirs."""
    cats, at = np.unique(cat, return_inverse=True)
    return scene * len(cats) + at, cats


EVERY = (("all", 0.0, 1e10),)
PACKED = "scene_id long, area string, cat int, rank long, score double, hits int, skips int"


def packed(dets: DataFrame, gts: DataFrame, by_category: bool = True, ranges: tuple[tuple[str, float, float], ...] = EVERY, max_det: int = 100, gt_no: bool = False, counted: bool = False) -> DataFrame:
    """One row for each detection and area range: which thresholds matched it (bits of hits) and ignored it (bits of skips).

    dets: (scene_id, det_no, label_id, score, box); gts: (scene_id, gt_no, gt_label, box, iscrowd). All ranges are
    matched in one pass over the scenes. With ``gt_no``, also the ground truth matched at each threshold, -1 for none.
    With ``counted``, rows that are ignored at all thresholds, and so count nowhere in precision, are left out.
    """
    box = ("x0", "y0", "x1", "y1")
    none = F.lit(None)
    d = dets.select("scene_id", F.lit(False).alias("is_gt"), (F.col("label_id") if by_category else F.lit(0)).cast("int").alias("cat"), F.col("det_no").cast("long").alias("no"), F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"), F.lit(False).alias("crowd"), *(F.col(c).cast("double").alias(c) for c in box))
    g = gts.select("scene_id", F.lit(True).alias("is_gt"), (F.col("gt_label") if by_category else F.lit(0)).cast("int").alias("cat"), F.col("gt_no").cast("long").alias("no"), none.cast("double").alias("score"), F.col("iscrowd").alias("crowd"), *(F.col(c).cast("double").alias(c) for c in box))
    every = (1 << len(IOU_THRESHOLDS)) - 1

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = {k: v[x["cat"] == x["cat"]] for k, v in x.items()}  # rows without a category take no part
        own, cats = _groups_of(places(x["scene_id"]), x["cat"])
        is_gt = x["is_gt"].astype(bool)
        one, two = ({k: v[mine] for k, v in x.items()} | {"cat": own[mine]} for mine in (~is_gt, is_gt))
        order = np.lexsort((one["no"], -one["score"], one["cat"]))
        cat = one["cat"][order]
        rank = np.arange(len(cat)) - np.searchsorted(cat, cat)
        one, rank = {k: v[order][rank < max_det] for k, v in one.items()}, rank[rank < max_det]
        two["crowd"] = two["crowd"].astype(bool)
        parts = []
        for name, hits, skips, nos in match_scene(one, two, IOU_THRESHOLDS, ranges):
            use = np.flatnonzero(skips != every) if counted else slice(None)
            part = {"cat": cats[one["cat"][use] % max(len(cats), 1)], "rank": rank[use], "score": one["score"][use], "hits": hits[use], "skips": skips[use]}
            part |= {"scene_id": one["scene_id"][use], "area": np.full(len(part["cat"]), name, dtype=object)}
            if gt_no:
                part["gt_nos"] = np.empty(len(part["cat"]), dtype=object)
                part["gt_nos"][:] = list(nos[use])
            parts.append(part)
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return per_group(d.unionByName(g), "scene_id", solve, PACKED + (", gt_nos array<long>" if gt_no else ""), ROWS_TOGETHER)


def _bit(bits: str, thr: Column) -> Column:
    return F.call_function("shiftright", F.col(bits), thr).bitwiseAND(F.lit(1)) == 1


def by_threshold(rows: DataFrame) -> DataFrame:
    """packed rows, one for each threshold: thr, matched, ignored."""
    thr = F.explode(F.array(*(F.lit(i) for i in range(len(IOU_THRESHOLDS))))).alias("thr")
    keep = [c for c in rows.columns if c not in ("hits", "skips", "gt_nos")]
    out = rows.select("*", thr)
    return out.select(*keep, "thr", _bit("hits", F.col("thr")).alias("matched"), _bit("skips", F.col("thr")).alias("ignored"), *([F.get("gt_nos", F.col("thr")).alias("gt_no")] if "gt_nos" in rows.columns else []))


def matches(dets: DataFrame, gts: DataFrame, by_category: bool = True, lo: float = 0.0, hi: float = 1e10, max_det: int = 100, gt_no: bool = False) -> DataFrame:
    """Matches of dets to gts in one area range, a row for each detection and threshold: scene_id, cat, rank, score, thr, matched, ignored (, gt_no)."""
    return by_threshold(packed(dets, gts, by_category, (("all", lo, hi),), max_det, gt_no)).drop("area")


def gt_counts(gts: DataFrame, lo: float = 0.0, hi: float = 1e10) -> DataFrame:
    a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return gts.filter(~F.col("iscrowd") & (a >= lo) & (a <= hi)).groupBy("scene_id", F.col("gt_label").cast("int").alias("cat")).agg(F.count("*").alias("n"))


def area_counts(gts: DataFrame, ranges: tuple[tuple[str, float, float], ...]) -> DataFrame:
    """gt_counts of several area ranges, told apart by ``area``."""
    out = None
    for name, lo, hi in ranges:
        part = gt_counts(gts, lo, hi).withColumn("area", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def score_bounds(dets: DataFrame, parts: int = 32, value: str = "score") -> list[float]:
    """Rough quantiles of the scores: where a running sum over scores is cut into parts. Any bounds give the same sums."""
    got = dets.agg(F.percentile_approx(value, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(1000))).collect()[0][0]
    return sorted(set(got or []))


def _npig(counts: DataFrame, weights: DataFrame | None, keys: list[str]) -> DataFrame:
    n = counts.join(weights, "scene_id") if weights is not None else counts.withColumn("w", F.lit(1).cast("long"))
    return n.groupBy(*keys).agg(F.sum(F.col("n") * F.col("w")).alias("npig")).filter("npig > 0")


def _counted(rows: DataFrame) -> list[Column]:
    """Sums of right and of all detections that are not ignored, at each threshold: for an aggregate or a window."""
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    out = []
    for i in range(len(IOU_THRESHOLDS)):
        out.append(F.sum(F.when(bit("hits", i) & ~bit("skips", i), F.col("w")).otherwise(0)))
        out.append(F.sum(F.when(~bit("skips", i), F.col("w")).otherwise(0)))
    return out


def precision_recall(rows: DataFrame, counts: DataFrame, keys: list[str], weights: DataFrame | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Recall and precision at every right detection, by keys and thr; rows are those of ``packed``. A wrong one only lowers precision at the recall of the right one before it.

    The order of detections is the same at all thresholds, so one sort serves them all. With ``bounds`` the running sums
    are taken within parts of the scores, which start from the totals of the parts above, so no task sorts a whole category.
    """
    m = rows.join(weights, "scene_id") if weights is not None else rows.withColumn("w", F.lit(1).cast("long"))
    m = m.withColumn("part", _parts(F.col("score"), bounds or []))
    n = len(IOU_THRESHOLDS)
    run = Window.partitionBy(*keys, "part").orderBy(F.desc("score"), "scene_id", "rank").rowsBetween(Window.unboundedPreceding, 0)
    right = F.col("hits").bitwiseAND(F.bitwise_not("skips"))
    sums = m.select(*keys, "part", right.alias("right"), *(c.over(run).alias(f"c{i}") for i, c in enumerate(_counted(m))))
    if bounds:
        above = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        base = m.groupBy(*keys, "part").agg(*(c.alias(f"b{i}") for i, c in enumerate(_counted(m))))
        base = base.select(*keys, "part", *(F.coalesce(F.sum(f"b{i}").over(above), F.lit(0)).alias(f"b{i}") for i in range(2 * n)))
        sums = sums.join(base, [*keys, "part"]).select(*keys, "right", *((F.col(f"c{i}") + F.col(f"b{i}")).alias(f"c{i}") for i in range(2 * n)))
    sums = sums.filter("right <> 0").join(_npig(counts, weights, keys), keys)
    each = F.array(*(F.struct(F.lit(i).alias("thr"), F.col(f"c{2 * i}").alias("tp"), F.col(f"c{2 * i + 1}").alias("n")) for i in range(n)))
    kept = F.filter(each, lambda x: F.call_function("shiftright", F.col("right"), x["thr"]).bitwiseAND(F.lit(1)) == 1)
    x = sums.select(*keys, "npig", F.explode(kept).alias("x"))
    return x.select(*keys, "x.thr", (F.col("x.tp") / F.col("npig")).alias("recall"), (F.col("x.tp") / (F.col("x.n") + F.lit(2.220446049250313e-16))).alias("precision"))


def ap_by_threshold(rows: DataFrame, counts: DataFrame, keys: list[str], weights: DataFrame | None = None, bounds: list[float] | None = None) -> DataFrame:
    """(keys, npig, aps): AP at each threshold as an array, 0 without detections; keys without ground truth are left out.

    A recall point takes the largest precision among detections whose recall reaches it, so the
    running sum is the only window over detections: the rest is a maximum for each of 101 points.
    """
    pr = precision_recall(rows, counts, keys, weights, bounds)
    near = F.floor(F.col("recall") * 100 + 0.5)  # the points are the doubles i * 0.01; only the nearest can be on either side
    reach = near + (near.cast("double") * F.lit(0.01) <= F.col("recall")).cast("long")  # points up to here
    top = pr.groupBy(*keys, "thr", reach.alias("k")).agg(F.max("precision").alias("p"))
    later = Window.partitionBy(*keys, "thr").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag("k", -1).over(Window.partitionBy(*keys, "thr").orderBy(F.desc("k"))), F.lit(0))
    steps = top.withColumn("best", F.max("p").over(later)).withColumn("width", F.col("k") - before)
    ap = steps.groupBy(*keys, "thr").agg((F.sum(F.col("best") * F.col("width")) / 101).alias("ap"))
    lists = ap.groupBy(*keys).agg(F.collect_list(F.struct("thr", "ap")).alias("l"))
    have = _npig(counts, weights, keys).join(lists, keys, "left")
    at = F.map_from_entries(F.coalesce("l", F.array().cast("array<struct<thr:int,ap:double>>")))
    aps = F.transform(F.array(*(F.lit(i) for i in range(len(IOU_THRESHOLDS)))), lambda i: F.coalesce(F.element_at(at, i), F.lit(0.0)))
    return have.select(*keys, "npig", aps.alias("aps"))


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def average_precision(rows: DataFrame, counts: DataFrame, weights: DataFrame | None = None, bounds: list[float] | None = None) -> DataFrame:
    """AP by (b,) cat: mean over thresholds and 101 recall points; b is a bootstrap replicate of weights (b, scene_id, w)."""
    keys = ["b", "cat"] if weights is not None else ["cat"]
    return ap_by_threshold(rows, counts, keys, weights, bounds).select(*keys, "npig", mean_of(F.col("aps")).alias("ap"))


SUMS_HELD = 64 << 20  # bytes of sums that a task holds

# ---- many replicates at once ----------------------------------------------------------


def weight_vectors(weights: DataFrame, replicates: int) -> DataFrame:
    """scene_id, wv: the weights (b, scene_id, w) of each scene in all replicates as bytes, 8 bits each, 16 where one is over 255; scenes that none drew are left out."""

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = np.zeros(replicates, "<u1" if x["w"].max() < 256 else "<u2")
        v[x["b"]] = x["w"]  # beyond 65,535 draws of one scene NumPy raises
        held = np.empty(1, object)
        held[0] = v.tobytes()
        return {"scene_id": x["scene_id"][:1], "wv": held}

    return per_group(weights.select("scene_id", "b", "w"), "scene_id", solve, "scene_id long, wv binary")


def _weights(vectors: np.ndarray, replicates: int) -> np.ndarray:
    """Vectors of ``weight_vectors`` as a matrix."""
    one = lambda v, n: np.frombuffer(v, f"<u{len(v) // (n * replicates)}").reshape(n, replicates).astype(np.int32)
    if len(vectors) and len({len(v) for v in vectors}) == 1:
        return one(b"".join(vectors), len(vectors))
    return np.concatenate([np.zeros((0, replicates), np.int32), *(one(v, 1) for v in vectors)])


def bootstrap_ap(rows: DataFrame, counts: DataFrame, weights: DataFrame, replicates: int, bounds: list[float]) -> DataFrame:
    """(b, cat, npig, ap) of ``average_precision`` for many replicates, without a row for each detection and replicate."""
    ap = weighted_ap if replicates < MANY else blocked_ap
    return ap(rows, counts, weights, replicates, ["cat"], bounds).select("b", "cat", "npig", mean_of(F.col("aps")).alias("ap"))


MANY = 64  # weightings from which on they go in blocks: below, a vector of weights is about as large as a detection
WIDTH, BLOCK_BYTES, RUN, LANES = 128, 128 << 20, 1024, 16  # weightings of a block, bytes of its weights, rows that travel as one, tasks of a block


def _packed_runs(key: str, columns: dict[str, str]):
    """A kernel over rows sorted by ``key``: RUN rows of a key at most become one, (key, seq, data), with the columns one after another in data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = None, 0
        for b in batches:
            k = b.column(b.schema.names.index(key)).to_numpy(zero_copy_only=False)
            x = {c: b.column(b.schema.names.index(c)).to_numpy().astype(t) for c, t in columns.items()}
            edges = np.flatnonzero(k[1:] != k[:-1]) + 1 if len(k) else np.zeros(0, np.int64)
            made = []
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(k)], strict=True):
                for lo in range(i, j, RUN):
                    seq = seq + 1 if k[i] == last else 0
                    last = k[i]
                    made.append((last, seq, b"".join(v[lo : min(lo + RUN, j)].tobytes() for v in x.values())))
            names, seqs, data = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.int64()), pa.array(data, pa.binary())], [key, "seq", "data"])

    return run


class _Run:
    """Running sums of detections by falling score under some weightings, and the largest precision at each recall point, from the sums tp and n of those above."""

    def __init__(self, npig: np.ndarray, tp: np.ndarray | None = None, n: np.ndarray | None = None):
        t, b = len(IOU_THRESHOLDS), len(npig)
        self.npig, self.top = npig, np.zeros((len(RECALL_POINTS) + 1, t, b))
        self.tp, self.n = (np.zeros((t, b)) if x is None else x for x in (tp, n))

    def detections(self, w: np.ndarray, hits: np.ndarray, skips: np.ndarray) -> None:
        """Running sums of a run of detections with weights w. A detection that a weighting leaves out repeats what the one before it gave, or less, so it needs no care."""
        every = np.cumsum(w, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(len(IOU_THRESHOLDS)):
                out, hit = np.flatnonzero((skips >> j) & 1), np.flatnonzero((hits & ~skips) >> j & 1)
                seen, last = every[hit], every[-1]
                if len(out):  # the sums of those that are ignored come off those of all
                    less = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w[out], axis=0)])
                    seen, last = seen - less[np.searchsorted(out, hit)], last - less[-1]
                if len(hit):
                    tp = np.cumsum(w[hit], axis=0) + self.tp[j]
                    seen += self.n[j] + np.finfo(float).eps
                    np.divide(tp, seen, out=seen)
                    seen[tp == 0] = 0
                    low, high = self.reach(tp[0]), self.reach(tp[-1])
                    same = np.flatnonzero(low == high)
                    top = seen.max(axis=0)
                    self.top[low[same], j, same] = np.maximum(self.top[low[same], j, same], top[same])
                    moved = np.flatnonzero(low != high)  # few: a weighting moves on a hundred times in all
                    if len(moved):
                        reach, own = self.reach(tp[:, moved], moved), seen[:, moved]
                        for r in range(int(low[moved].min()), int(high[moved].max()) + 1):
                            self.top[r, j, moved] = np.maximum(self.top[r, j, moved], np.where(reach == r, own, 0).max(axis=0))
                    self.tp[j] = tp[-1]
                self.n[j] += last

    def reach(self, tp: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        """How many recall points after the first tp right ones reach, plus one for that first point; 0 without ground truth."""
        n = self.npig if c is None else self.npig[c]
        recall = np.where(n > 0, tp / n, 0)
        near = np.floor(recall * 100 + 0.5).astype(np.int64)  # only the nearest point can be on either side
        return np.where(n > 0, near + (RECALL_POINTS[near] <= recall), 0)


class _Scan:
    """The state of ``blocked_ap``'s task: the weights of a block of weightings, then groups one after another: their ground truth, then their detections by falling score."""

    def __init__(self, width: Callable[[int], int]):
        self.width, self.parts, self.w, self.grp, self.out = width, [], None, None, []

    def rows(self, x: dict[str, np.ndarray]) -> None:
        for kind, grp, data in zip(x["kind"].tolist(), x["grp"].tolist(), x["data"].tolist(), strict=True):
            if kind == 0:
                self.block = grp
                v = np.frombuffer(data, np.uint8)
                size = int(v[0])
                self.parts.append(v[1:].view(f"<u{size}").reshape(-1, self.width(int(grp))))
                continue
            if self.w is None:
                self.w = np.concatenate(self.parts)
                self.parts = []
            if grp != self.grp:
                self.close()
                self.grp, self.run = grp, _Run(np.zeros(self.w.shape[1]))
            half = len(data) // 2
            one, two = np.frombuffer(data[:half], np.int32), np.frombuffer(data[half:], np.int32)
            if kind == 1:
                self.run.npig += two.astype(float) @ self.w[one]
            else:
                self.run.detections(self.w[one].astype(float), two & ((1 << len(IOU_THRESHOLDS)) - 1), two >> len(IOU_THRESHOLDS))

    def close(self) -> None:
        if self.grp is None:
            return
        live = np.flatnonzero(self.run.npig > 0)
        self.out.append((self.grp, int(self.block), live, self.run.npig[live].astype(np.int64), _aps(self.run.top)[live]))


def _aps(top: np.ndarray) -> np.ndarray:
    """AP by weighting and threshold: a recall point takes the largest precision of those that reach it."""
    return (np.maximum.accumulate(top[:0:-1], axis=0).sum(axis=0) / len(RECALL_POINTS)).T


def blocked_ap(rows: DataFrame, counts: DataFrame, weights: DataFrame, replicates: int, keys: list[str], bounds: list[float]) -> DataFrame:
    """``weighted_ap`` for many weightings: (b, keys, npig, aps). weights: (b, scene_id, w), or (scene_id, wv) as ``weight_vectors`` makes them.

    No detection carries weights. A task has the weights of one block of weightings for all scenes (BLOCK_BYTES at most, or a byte or two a scene and
    weighting of the narrowest block) and meets the detections of some keys by falling score: a few bytes each, sorted once for all blocks, in parts of the scores.
    """
    vectors = cut(weights if "wv" in weights.columns else weight_vectors(weights, replicates))
    no = cut(numbered(vectors.select("scene_id"), ["scene_id"], "no"))
    n = no.count()
    width = max(16, min(WIDTH, BLOCK_BYTES // max(n, 1)))
    blocks = -(-replicates // width)
    here = lambda k: min(width, replicates - k * width)
    grp = F.concat_ws("/", *keys).alias("grp")
    lanes = F.pmod(F.xxhash64("grp"), F.lit(LANES)).alias("lane")
    used = [r["lane"] for r in counts.select(grp).distinct().select(lanes).distinct().collect()]  # LANES at most
    spark = counts.sparkSession

    def sliced(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        o = np.argsort(x["no"])
        v = _weights(x["wv"][o], replicates)
        v = v.astype("<u1" if v.max(initial=0) < 256 else "<u2")
        data = np.empty(blocks, object)
        data[:] = [bytes([v.itemsize]) + np.ascontiguousarray(v[:, k * width : k * width + here(k)]).tobytes() for k in range(blocks)]
        return {"slice": np.repeat(x["slice"][:1], blocks), "block": np.arange(blocks), "data": data}

    of = per_group(vectors.join(no.hint("merge"), "scene_id").select(F.expr(f"no div {RUN}").alias("slice"), "no", "wv"), "slice", sliced, "slice long, block int, data binary")
    lane = F.broadcast(spark.createDataFrame([(x,) for x in used], "lane long"))
    first = of.crossJoin(lane).select(F.concat_ws("/", "lane", "block").alias("key"), F.lit(0).alias("kind"), F.col("block").cast("string").alias("grp"), F.lit(0).alias("part"), F.col("slice").alias("seq"), "data")

    def travel(kind: int, df: DataFrame, order: list, columns: dict[str, str]) -> DataFrame:
        """Runs of df (grp, part, ...), sorted within grp and part, once for each block."""
        met = df.withColumn("own", F.concat_ws("/", "part", "grp"))
        runs = met.repartition(F.xxhash64("own")).sortWithinPartitions("own", *order).select("own", *columns).mapInArrow(_packed_runs("own", columns), "own string, seq long, data binary")
        split = runs.select(F.expr("substring(own, instr(own, '/') + 1)").alias("grp"), F.substring_index("own", "/", 1).cast("int").alias("part"), "seq", "data").join(lane, lanes == lane["lane"])
        block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        return split.select(block, "lane", "grp", "part", "seq", "data").select(F.concat_ws("/", "lane", "block").alias("key"), F.lit(kind).alias("kind"), "grp", "part", "seq", "data")

    g = counts.join(no.hint("merge"), "scene_id").select(grp, F.lit(0).alias("part"), F.col("no").cast("int").alias("no"), F.col("n").cast("int").alias("n"))
    full = (1 << len(IOU_THRESHOLDS)) - 1
    bits = F.col("hits").bitwiseOR(F.shiftleft("skips", len(IOU_THRESHOLDS))).alias("bits")
    d = rows.filter(F.col("skips") != full).join(no.hint("merge"), "scene_id").select(grp, _parts(F.col("score"), bounds).alias("part"), "score", "scene_id", "rank", F.col("no").cast("int").alias("no"), bits)
    every = first.unionByName(travel(1, g, ["no"], {"no": "<i4", "n": "<i4"})).unionByName(travel(2, d, [F.desc("score"), "scene_id", "rank"], {"no": "<i4", "bits": "<i4"}))

    def done(state: _Scan) -> dict[str, np.ndarray]:
        state.close()
        names = [np.full(len(live), name, object) for name, _, live, _, _ in state.out]
        aps = [list(a) for *_, a in state.out]
        flat = np.empty(sum(map(len, aps)), object)
        flat[:] = [v for a in aps for v in a]
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return {"b": cat([k * width + live for _, k, live, _, _ in state.out]), "grp": np.concatenate([np.zeros(0, object), *names]), "npig": cat([m for *_, m, _ in state.out]), "aps": flat}

    order = [F.when(F.col("kind") == 0, "").otherwise(F.col("grp")), "kind", F.desc("part"), "seq"]
    out = streamed(every, "key", order, lambda: _Scan(here), _Scan.rows, done, "b long, grp string, npig long, aps array<double>")
    split = F.split("grp", "/")
    return out.select("b", *(split[i].cast(counts.schema[k].dataType).alias(k) for i, k in enumerate(keys)), "npig", "aps")


def weighted_ap(rows: DataFrame, counts: DataFrame, weights: DataFrame, replicates: int, keys: list[str], bounds: list[float]) -> DataFrame:
    """(b, keys, npig, aps) of ``ap_by_threshold`` under each of many weightings (b, scene_id, w) of the scenes: replicates, or subsets with weights 0 and 1.

    A detection carries the vector of its scene's weights. The detections of a key and part of the scores are summed up, vector by vector, in
    one sorted run that starts from the totals of the parts above; a part gives, for each threshold, weighting and recall point it
    reaches, the largest precision, and a key puts its parts together.
    """
    t, points = len(IOU_THRESHOLDS), len(RECALL_POINTS)
    step = max(64, min(4096, (1 << 18) // replicates))
    vectors = cut(weight_vectors(weights, replicates))
    grp = F.concat_ws("/", *keys).alias("grp")
    m = rows.filter(F.col("skips") != (1 << t) - 1).join(vectors.hint("merge"), "scene_id").select(grp, _parts(F.col("score"), bounds).alias("part"), "score", "scene_id", "rank", "hits", "skips", "wv")
    m = stored(m)

    def lines(x: dict[str, np.ndarray]):
        """(right, valid) of each threshold and the weights, some rows at a time."""
        for lo in range(0, len(x["wv"]), step):
            hits, skips = (((x[c][lo : lo + step].astype(np.int64)[:, None] >> np.arange(t)) & 1).astype(bool) for c in ("hits", "skips"))
            yield hits & ~skips, ~skips, _weights(x["wv"][lo : lo + step], replicates)

    def obj(values: list[bytes]) -> np.ndarray:
        out = np.empty(len(values), object)
        out[:] = values
        return out

    def summed(key: str, totals: Callable[[dict[str, np.ndarray]], np.ndarray]):
        """A kernel that sums ``totals`` (whole numbers, as doubles) of the rows of each key, a row for each key a task has; more than SUMS_HELD bytes of sums leave early."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()], pa.binary())], [key, "total"])

            for b in batches:
                x = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)}
                names, at = np.unique(x[key].astype(str), return_inverse=True)
                order, edge = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(names) + 1))
                for i, name in enumerate(names.tolist()):
                    own = order[edge[i] : edge[i + 1]]
                    for lo in range(0, len(own), step):
                        v = totals({c: a[own[lo : lo + step]] for c, a in x.items()})
                        held[name] = held[name] + v if name in held else v
                    if len(held) * held[name].nbytes > SUMS_HELD:
                        yield out()
                        held.clear()
            if held:
                yield out()

        return run

    def together(key: str):
        return lambda x: {key: x[key][:1], "total": obj([sum(np.frombuffer(v) for v in x["total"]).tobytes()])}

    def of_rows(x: dict[str, np.ndarray]) -> np.ndarray:
        total = np.zeros((2, t, replicates))
        for right, valid, w in lines(x):
            both = np.concatenate([right, valid], axis=1).T.astype(float)
            total += (both @ w.astype(float)).reshape(2, t, replicates)
        return total

    drawn = lambda x: x["n"].astype(float) @ _weights(x["wv"], replicates).astype(float)
    npig = counts.join(vectors.hint("merge"), "scene_id").select(grp, "n", "wv").mapInArrow(summed("grp", drawn), "grp string, total binary")
    npig = cut(per_group(npig, "grp", together("grp"), "grp string, total binary").withColumnRenamed("total", "npig"))
    keyed = m.select(F.concat_ws("/", "grp", "part").alias("key"), "hits", "skips", "wv")
    of_parts = per_group(keyed.mapInArrow(summed("key", of_rows), "key string, total binary"), "key", together("key"), "key string, total binary")
    of_parts = of_parts.select(F.substring_index("key", "/", len(keys)).alias("grp"), F.substring_index("key", "/", -1).cast("int").alias("part"), "total")

    def bases(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        o = np.argsort(-x["part"], kind="stable")
        run, out = np.zeros((2, t, replicates)), []
        for i in o:
            out.append(run.astype(np.int64).tobytes())
            run = run + np.frombuffer(x["total"][i]).reshape(run.shape)
        return {"grp": x["grp"][o], "part": x["part"][o], "base": obj(out), "npig": obj([np.frombuffer(v).astype(np.int64).tobytes() for v in x["npig"][o]])}

    base = per_group(of_parts.join(npig, "grp"), "grp", bases, "grp string, part int, base binary, npig binary")
    none = [F.lit(None).cast(c).alias(n) for n, c in (("score", "double"), ("scene_id", "long"), ("rank", "long"), ("hits", "int"), ("skips", "int"), ("wv", "binary"))]
    first = base.select(F.concat_ws("/", "grp", "part").alias("key"), "grp", *none, "base", "npig")
    both = first.unionByName(m.select(F.concat_ws("/", "grp", "part").alias("key"), "grp", "score", "scene_id", "rank", "hits", "skips", "wv"), allowMissingColumns=True)

    def go(state: dict, x: dict[str, np.ndarray]) -> None:
        """The base comes first, then detections by falling score."""
        if "run" not in state and x["base"][0] is not None:
            state["at"] = x["grp"][0]
            state["run"] = np.frombuffer(x["base"][0], np.int64).reshape(2, t, replicates).copy()
            state["npig"] = np.frombuffer(x["npig"][0], np.int64)
            x = {c: v[1:] for c, v in x.items()}
        if "run" not in state:  # a category without ground truth
            return
        run, n, top = state["run"], state["npig"], state["top"]
        for right, valid, w in lines(x):
            every = np.cumsum(w, axis=0, dtype=np.int32)  # a slice's sums stay far below 2**31
            for j in range(t):
                hit, out = np.flatnonzero(right[:, j]), np.flatnonzero(~valid[:, j])
                if 2 * len(out) <= len(w):  # the sums of the few that are ignored come off those of all
                    less = np.concatenate([np.zeros((1, replicates), np.int32), np.cumsum(w[out], axis=0, dtype=np.int32)])
                    seen, last = every[hit] - less[np.searchsorted(out, hit)], every[-1] - less[-1]
                else:
                    few = np.flatnonzero(valid[:, j])
                    up = np.cumsum(w[few], axis=0, dtype=np.int32)
                    seen, last = up[np.searchsorted(few, hit)], up[-1] if len(few) else 0
                if len(hit):
                    own = w[hit]
                    tp = run[0, j] + np.cumsum(own, axis=0, dtype=np.int32)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        recall = np.where(n > 0, tp / n, 0)
                        precision = np.where(own > 0, tp / (run[1, j] + seen + np.finfo(float).eps), 0)
                    near = np.floor(recall * 100 + 0.5).astype(np.int64)  # only the nearest point can be on either side
                    reach = np.where(n > 0, near + (RECALL_POINTS[near] <= recall), 0)
                    low, high = int(reach.min()), int(reach.max())
                    if high - low < 4:
                        for r in range(low, high + 1):
                            np.maximum(top[r, j], np.where(reach == r, precision, 0).max(axis=0), out=top[r, j])
                    else:
                        np.maximum.at(top, (reach, j, np.arange(replicates)[None, :]), precision)
                    run[0, j] = tp[-1]
                run[1, j] += last

    def done(state: dict) -> dict[str, np.ndarray]:
        """What the part reaches, from the lowest to the highest recall point."""
        used = np.flatnonzero(state["top"].any(axis=(1, 2)))
        if "run" not in state or not len(used):
            return {"grp": np.zeros(0, object), "low": np.zeros(0), "best": np.zeros(0, object), "npig": np.zeros(0, object)}
        low, high = int(used[0]), int(used[-1])
        return {"grp": obj([state["at"]]), "low": np.array([low]), "best": obj([state["top"][low : high + 1].tobytes()]), "npig": obj([state["npig"].tobytes()])}

    found = streamed(both, "key", [F.desc_nulls_first("score"), "scene_id", "rank"], lambda: {"top": np.zeros((points + 1, t, replicates))}, go, done, "grp string, low int, best binary, npig binary")

    def whole(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        top = np.zeros((points + 1, t, replicates))
        for low, v in zip(x["low"], x["best"], strict=True):
            part = np.frombuffer(v).reshape(-1, t, replicates)
            np.maximum(top[low : low + len(part)], part, out=top[low : low + len(part)])
        n = np.frombuffer(x["npig"][0], np.int64)
        reached = np.maximum.accumulate(top[:0:-1], axis=0)  # a point takes the largest precision of those that reach it
        live = np.flatnonzero(n > 0)
        return {"b": live, "grp": np.repeat(x["grp"][:1], len(live)), "aps": obj(list((reached.sum(axis=0) / points).T[live]))}

    def every(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = np.frombuffer(x["npig"][0]).astype(np.int64)
        live = np.flatnonzero(n > 0)
        return {"b": live, "grp": np.repeat(x["grp"][:1], len(live)), "npig": n[live]}

    aps = per_group(found, "grp", whole, "b long, grp string, aps array<double>")
    have = per_group(npig, "grp", every, "b long, grp string, npig long")  # keys without any detection have AP 0 where they have ground truth
    split = F.split("grp", "/")
    typed = [split[i].cast(counts.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    return have.join(aps, ["b", "grp"], "left").select("b", *typed, "npig", F.coalesce("aps", F.array_repeat(F.lit(0.0), t)).alias("aps"))


# ---- subsets and areas at once ---------------------------------------------------------

FULL = (1 << len(IOU_THRESHOLDS)) - 1
IN_ONE = 3  # choices of right and counted thresholds that one whole number holds


SUMMED = 200_000  # rows that are summed up at once


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, several as one until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _columns(k: int) -> list[str]:
    return [f"m{i}" for i in range(-(-k // IN_ONE))]


def _bits(x: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(right, counted) of choice k: at which thresholds."""
    v = x[f"m{k // IN_ONE}"].astype(np.int64) >> (k % IN_ONE * 2 * len(IOU_THRESHOLDS))
    return v & FULL, (v >> len(IOU_THRESHOLDS)) & FULL


def every_mask(det: dict, gt: dict) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    return [np.ones(len(det["scene"]), bool)], {}


def judged(dets: DataFrame, gts: DataFrame, scenes: DataFrame, ranges: tuple[tuple[str, float, float], ...] = EVERY, max_det: int = 100, choose: Callable = every_mask, picks: int = 1, more: str = "") -> DataFrame:
    """Matches of ``picks`` choices of detections in all ranges, with what a scene weighs: (scene_id, cat, rank, score, m0, ..., sub, wv, more), all from one reading of a scene.

    scenes: (scene_id, sub[, wv]), the subsets of a scene as bits and its weights; other scenes take no part. ``choose`` gives, from (scene, cat,
    no, score, box) of detections and of ground truth (with crowd), a flag for each choice and detection, and the columns ``more``. Right and counted thresholds of
    choice c and range r are bits of m: number c * ranges + r. Ground truth is of rank -1, right where its range counts it. Rows that count nowhere stay out, but for those with ``more``.
    """
    box, wide, k = ("x0", "y0", "x1", "y1"), "wv" in scenes.columns, picks * len(ranges)
    extra = [f.split() for f in more.split(", ")] if more else []
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    side = lambda kind, cat, no, score, crowd: ["scene_id", F.lit(kind).alias("kind"), cat.cast("int").alias("cat"), F.col(no).cast("long").alias("no"), score.alias("score"), crowd.alias("crowd"), *(F.col(c).cast("double").alias(c) for c in box), F.lit(0).cast("long").alias("sub"), *([none("binary", "wv")] if wide else [])]
    d = dets.select(*side(0, F.col("label_id"), "det_no", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))), F.lit(False)))
    g = gts.select(*side(1, F.col("gt_label"), "gt_no", F.lit(0.0), F.col("iscrowd")))
    v = scenes.select("scene_id", F.lit(2).alias("kind"), none("int", "cat"), F.lit(0).cast("long").alias("no"), F.lit(0.0).alias("score"), F.lit(False).alias("crowd"), *(none("double", c) for c in box), F.col("sub").cast("long").alias("sub"), *(["wv"] if wide else []))
    low, high = (np.array([r[i] for r in ranges]) for i in (1, 2))

    def solve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x["scene"], x["crowd"] = places(x["scene_id"]), x["crowd"].astype(bool)
        of = np.flatnonzero(x["kind"] == 2)
        at = np.full(x["scene"][-1] + 1, -1)
        at[x["scene"][of]] = of
        x = {c: a[at[x["scene"]] >= 0] for c, a in (x | {"at": at[x["scene"]], "sub": x["sub"][at[x["scene"]]]} | ({"wv": x["wv"][at[x["scene"]]]} if wide else {})).items()}
        det, gt = ({c: a[x["kind"] == i] for c, a in x.items()} for i in (0, 1))
        flags, columns = choose(det, gt)
        det, gt = (y | {"own": np.isfinite(y["cat"].astype(float))} for y in (det, gt))  # rows without a category match nothing
        cats = np.unique(np.concatenate([y["cat"][y["own"]] for y in (det, gt)]))
        code = lambda y: y["scene"] * max(len(cats), 1) + np.searchsorted(cats, np.where(y["own"], y["cat"], cats[0] if len(cats) else 0))
        two = {c: gt[c][gt["own"]] for c in ("no", "crowd", *box)} | {"cat": code(gt)[gt["own"]]}
        mine, m = code(det), np.zeros((len(det["scene"]), -(-k // IN_ONE)), np.int64)
        order = np.lexsort((det["no"], -det["score"], mine))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(mine[order], mine[order])
        shift = lambda i: i % IN_ONE * 2 * len(IOU_THRESHOLDS)
        for c, flag in enumerate(flags):
            use = order[(flag & det["own"])[order]]
            use = use[np.arange(len(use)) - np.searchsorted(mine[use], mine[use]) < max_det]
            for r, (_, hits, skips, _) in enumerate(match_scene({b: det[b][use] for b in box} | {"cat": mine[use]}, two, IOU_THRESHOLDS, ranges)):
                i = c * len(ranges) + r
                m[use, i // IN_ONE] |= ((hits & ~skips) | ((~skips & FULL) << len(IOU_THRESHOLDS))) << shift(i)
        keep = np.flatnonzero((m != 0).any(axis=1) | (flags[0] if extra else False))
        area = (two["x1"] - two["x0"]) * (two["y1"] - two["y0"])
        n = np.zeros((len(area), m.shape[1]), np.int64)
        for i in range(k):
            n[:, i // IN_ONE] |= (~two["crowd"] & (area >= low[i % len(ranges)]) & (area <= high[i % len(ranges)])).astype(np.int64) << shift(i)
        some = np.flatnonzero((n != 0).any(axis=1))
        both = lambda a, b: np.concatenate([a[keep], b[gt["own"]][some]])
        cat = both(np.where(det["own"], det["cat"], -1), gt["cat"]).astype(np.int64)
        out = {"scene_id": both(det["scene_id"], gt["scene_id"]), "cat": cat, "rank": np.concatenate([rank[keep], np.full(len(some), -1)]), "score": both(det["score"], gt["score"])}
        out |= {c: np.concatenate([m[keep, i], n[some, i]]) for i, c in enumerate(_columns(k))} | {"sub": both(det["sub"], gt["sub"])}
        if wide:
            out["wv"] = both(det["wv"], gt["wv"])
        return out | {c: np.concatenate([columns[c][keep], np.full(len(some), -1)]) for c, _ in extra}

    schema = ["scene_id long", "cat int", "rank int", "score double", *(f"{c} long" for c in _columns(k)), "sub long", *(["wv binary"] if wide else []), *(" ".join(f) for f in extra)]
    return per_group(d.unionByName(g).unionByName(v), "scene_id", solve, ", ".join(schema), ROWS_TOGETHER)


def judged_ap(rows: DataFrame, k: int, subsets: int, bounds: list[float], replicates: int = 1) -> DataFrame:
    """(cat, k, at, b, npig, aps) for each of ``k`` choices and ranges, each subset (a bit of sub, at most 62) and each replicate of its weights, from stored rows of ``judged``.

    A category is summed up in parts of the scores, each from the totals of the parts above, in one sorted run for all choices, subsets and replicates. Without
    weights the subsets are columns of one matrix; with them a detection meets the weights of its scene in the subsets it is in.
    """
    t, wide = len(IOU_THRESHOLDS), "wv" in rows.columns
    blocks, width = (subsets, replicates) if wide else (1, subsets)
    columns = _columns(k)
    size = k * blocks * width  # weightings
    m = rows.filter(" OR ".join(f"{c} <> 0" for c in columns))
    key = F.concat_ws("/", "cat", F.when(F.col("rank") < 0, "gt").otherwise(_parts(F.col("score"), bounds).cast("string"))).alias("key")
    data = ["score", "scene_id", "rank", *columns, "sub", *(["wv"] if wide else [])]

    def weights(x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, weights) of each block."""
        if not wide:
            yield np.arange(len(x["sub"])), ((x["sub"].astype(np.int64)[:, None] >> np.arange(subsets)) & 1).astype(float)
            return
        w = _weights(x["wv"], replicates).astype(float)
        for s in range(subsets):
            own = np.flatnonzero((x["sub"].astype(np.int64) >> s) & 1)
            yield own, w[own]

    def one(values: list[bytes]) -> np.ndarray:
        out = np.empty(len(values), object)
        out[:] = values
        return out

    spread = lambda v: ((v[:, None] >> np.arange(t)) & 1).astype(float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals of right and of counted ones by key, (2, t) by choice, block and weighting; a row for each key a task has, or more where they pass SUMS_HELD."""
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["key", "total"])

        for b in _gathered(batches, SUMMED):
            x = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)}
            names, at = np.unique(x["key"], return_inverse=True)
            order, edge = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(names) + 1))
            for i, name in enumerate(names.tolist()):
                part = {c: a[order[edge[i] : edge[i + 1]]] for c, a in x.items()}
                total = held.setdefault(name, np.zeros((k, blocks, 2, t, width), np.int64))
                for j, (own, w) in enumerate(weights(part)):
                    for c in range(k):
                        right, seen = (v[own] for v in _bits(part, c))
                        hit, less = np.flatnonzero(right), np.flatnonzero((seen != 0) & (seen != FULL))
                        total[c, j, 0] += (spread(right[hit]).T @ w[hit]).astype(np.int64)
                        total[c, j, 1] += (w[seen != 0].sum(axis=0) - spread(~seen[less]).T @ w[less]).astype(np.int64)
                if len(held) * total.nbytes > SUMS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def bases(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The sums above each part of a category, and its ground truth."""
        parts: dict[str, np.ndarray] = {}
        for name, v in zip(x["part"].tolist(), x["total"], strict=True):
            v = np.frombuffer(v, np.int64).reshape(k, blocks, 2, t, width)
            parts[name] = parts[name] + v if name in parts else v
        if "gt" not in parts:
            return {"key": one([]), "base": one([]), "npig": one([])}
        npig, run, out = parts.pop("gt")[:, :, 0, 0].tobytes(), np.zeros((k, blocks, 2, t, width), np.int64), []
        for name in sorted(parts, key=int, reverse=True):
            out.append((f"{x['cat'][0]}/{name}", run.tobytes()))
            run = run + parts[name]
        out.append((f"{x['cat'][0]}/gt", b""))
        return {"key": one([n for n, _ in out]), "base": one([v for _, v in out]), "npig": one([npig] * len(out))}

    totals = m.select(key, *data[3:]).mapInArrow(sums, "key string, total binary")
    totals = totals.select(F.substring_index("key", "/", 1).alias("cat"), F.substring_index("key", "/", -1).alias("part"), "total")
    base = stored(per_group(totals, "cat", bases, "key string, base binary, npig binary"))
    lines = m.filter("rank >= 0").select(key, *data)
    first = base.filter("length(base) > 0").select("key", *(F.lit(None if c in ("score", "wv") else 0).cast(lines.schema[c].dataType).alias(c) for c in data), "base", "npig")  # no nulls in whole numbers: they would travel as doubles
    every = first.unionByName(lines, allowMissingColumns=True)

    def go(state: dict, x: dict[str, np.ndarray]) -> None:
        if "runs" not in state and x["base"][0] is not None:
            total, npig = np.frombuffer(x["base"][0], np.int64).reshape(k, blocks, 2, t, width), np.frombuffer(x["npig"][0], np.int64).reshape(k, blocks, width)
            state["cat"], state["npig"] = x["key"][0].split("/")[0], x["npig"][0]
            state["runs"] = [[_Run(npig[c, j].astype(float), *total[c, j].astype(float)) for j in range(blocks)] for c in range(k)]
            x = {c: v[1:] for c, v in x.items()}
        if "runs" not in state or not len(x["key"]):  # a category without ground truth
            return
        for lo in range(0, len(x["key"]), step := max(64, min(4096, (1 << 19) // width))):
            some = {c: x[c][lo : lo + step] for c in (*columns, "sub", *(["wv"] if wide else []))}
            for j, (own, w) in enumerate(weights(some)):
                for c in range(k):
                    right, seen = (v[own] for v in _bits(some, c))
                    use = np.flatnonzero(seen)
                    if len(use):
                        state["runs"][c][j].detections(w if len(use) == len(own) else w[use], right[use], ~seen[use] & FULL)

    def done(state: dict) -> dict[str, np.ndarray]:
        if "runs" not in state:
            return {"cat": one([]), "low": np.zeros(0, np.int64), "best": one([]), "npig": one([])}
        top = np.stack([np.stack([r.top for r in some]) for some in state["runs"]])
        used = np.flatnonzero(top.any(axis=(0, 1, 3, 4)))
        lo, hi = (int(used[0]), int(used[-1])) if len(used) else (0, 0)
        return {"cat": one([state["cat"]]), "low": np.array([lo]), "best": one([np.ascontiguousarray(top[:, :, lo : hi + 1]).tobytes()]), "npig": one([state["npig"]])}

    found = streamed(every, "key", [F.desc_nulls_first("score"), "scene_id", "rank"], dict, go, done, "cat string, low int, best binary, npig binary")
    alone = base.filter("length(base) = 0").select(F.substring_index("key", "/", 1).alias("cat"), F.lit(0).alias("low"), F.lit(None).cast("binary").alias("best"), "npig")  # categories without a detection have AP 0

    def whole(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        top, npig = np.zeros((k, blocks, len(RECALL_POINTS) + 1, t, width)), np.frombuffer(x["npig"][0], np.int64)
        for low, v in zip(x["low"], x["best"], strict=True):
            if v is not None:
                part = np.frombuffer(v).reshape(k, blocks, -1, t, width)
                np.maximum(top[:, :, low : low + part.shape[2]], part, out=top[:, :, low : low + part.shape[2]])
        aps = np.concatenate([_aps(top[c, j]) for c in range(k) for j in range(blocks)])
        live = np.flatnonzero(npig > 0)
        each = live % (blocks * width)
        return {"cat": np.full(len(live), int(x["cat"][0])), "k": live // (blocks * width), "at": each // replicates, "b": each % replicates, "npig": npig[live], "aps": one(list(aps[live]))}

    return per_group(found.unionByName(alone), "cat", whole, "cat int, k int, at long, b long, npig long, aps array<double>")


def average_recall(rows: DataFrame, counts: DataFrame, max_det: int, keys: list[str] | None = None) -> DataFrame:
    """AR over thresholds and categories with ground truth, at max_det detections per scene and category, by keys; rows are those of ``packed``."""
    keys = keys or []
    right = F.bit_count(F.col("hits").bitwiseAND(F.bitwise_not("skips")))
    tp = rows.filter(F.col("rank") < max_det).groupBy(*keys, "cat").agg(F.sum(right).alias("tp"))
    n = counts.groupBy(*keys, "cat").agg(F.sum("n").alias("n"))
    r = n.join(tp, [*keys, "cat"], "left").select(*keys, (F.coalesce("tp", F.lit(0)) / F.col("n") / len(IOU_THRESHOLDS)).alias("r"))
    agg = (F.lit(max_det).alias("max_det"), F.round(F.avg("r"), 9).alias("ar"))
    return r.groupBy(*keys).agg(*agg) if keys else r.agg(*agg)


def _parts(value: Column, bounds: list[float]) -> Column:
    """The part of a value between bounds; nulls, which come first, are in part 0."""
    part = F.lit(0)
    for x in bounds:
        part = part + F.coalesce((value >= x).cast("int"), F.lit(0))
    return part


def summed_below(df: DataFrame, by: list[str], value: str, amount: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``amount`` over the rows of smaller ``value``, by group; values are distinct in a group.

    Running sums are taken within parts of the values and start from the totals of the parts below, so no task sorts a whole group.
    """
    df = cut(df)
    d = df.withColumn("_part", _parts(F.col(value), score_bounds(df, value=value)))
    total = d.groupBy(*by, "_part").agg(F.sum(amount).alias("_t"))
    lower = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    total = total.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_base"))
    run = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_run", F.coalesce(F.sum(amount).over(run), F.lit(0)))
    on = [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))]
    return d.join(total, on).select(*df.columns, (F.col("_run") + F.col("_base")).alias(out))


def auroc(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Weighted AUROC, ties one half, of (positive, s[, weight]); null if a class is empty. Scores are grouped first, then summed in parts."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    g = scored.groupBy(*by, "s").agg(F.sum(F.when(F.col("positive"), w).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), w).otherwise(0)).alias("n"))
    g = summed_below(g, by, "s", "n", "under")
    agg = [F.try_divide(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc")]
    return g.groupBy(*by).agg(*agg) if by else g.agg(*agg)


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average rank of equal values: from counts of distinct values, summed in parts and joined back by value."""
    by = by or []
    g = summed_below(df.groupBy(*by, value).agg(F.count("*").alias("_c")), by, value, "_c", "_under")
    rank = (F.col("_under") + (F.col("_c") + 1) / 2).alias(out)
    g = g.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])), rank)
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"g._k{i}")) for i, c in enumerate([*by, value])]
    return df.alias("d").join(g.alias("g"), on).select("d.*", f"g.{out}")


def rejection(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates of decisions (known, label_id, y_hat): false positives of unknowns; misses and right answers of knowns."""
    c = lambda cond: F.count_if(cond)
    answered = F.col("y_hat") != -1
    aggs = [
        F.try_divide(c(~F.col("known") & answered), c(~F.col("known"))).alias("fpr"),
        F.try_divide(c(F.col("known") & ~answered), c(F.col("known"))).alias("miss"),
        F.try_divide(c(F.col("known") & answered & (F.col("y_hat") == F.col("label_id"))), c(F.col("known"))).alias("correct"),
    ]
    return decisions.groupBy(*by).agg(*aggs) if by else decisions.agg(*aggs)
