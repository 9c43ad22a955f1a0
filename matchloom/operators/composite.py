"""Whole evaluations: precision, recall, top-1 and AUROC by subset of scenes and area, from one matching pass.

Subsets are named ``split/level``, with ``all`` for either. Defined results: subsets and areas without ground truth
have no precision row but keep their counts; a class that is empty leaves AUROC null; scenes in no subset count nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import stored
from . import metrics as M
from . import nesting as N
from .boxes import area_bin
from .kernel import pairs_within

AREAS = ("small", "medium", "large")


def subsets(scenes: DataFrame) -> DataFrame:
    """(scene_id, subset) of scenes (scene_id, split, level): each scene is in four subsets."""
    name = lambda a, b: F.concat(a, F.lit("/"), b)
    every, split, level = F.lit("all"), F.col("split"), F.col("level")
    return scenes.select("scene_id", F.explode(F.array(name(every, every), name(split, every), name(every, level), name(split, level))).alias("subset"))


AT_ONCE = 60  # subsets that one whole number tells


def numbers(of: DataFrame) -> list[tuple[DataFrame, DataFrame, int]]:
    """(scenes, names, n) of each AT_ONCE subsets: what ``judged`` takes, (scene_id, sub), and (at, subset) of the n names."""
    names, out = sorted(r["subset"] for r in of.select("subset").distinct().collect()), []  # a name for each subset
    for lo in range(0, len(names), AT_ONCE):
        some = names[lo : lo + AT_ONCE]
        number = F.broadcast(of.sparkSession.createDataFrame(list(enumerate(some)), "at long, subset string"))
        bits = F.expr("bit_or(shiftleft(1L, CAST(at AS INT)))").alias("sub")
        out.append((of.join(number, "subset").groupBy("scene_id").agg(bits), number, len(some)))
    return out


def precision(dets: DataFrame, gts: DataFrame, of: DataFrame, ranges: tuple, max_det: int = 1000, choose: Callable = M.every_mask, more: str = "", use: Callable | None = None) -> DataFrame:
    """(subset, area, n_gt, n_categories, ap, ap50, ap75): means over the categories with ground truth, of the detections that ``choose`` takes.

    A scene is read once: its detections are chosen and matched, and leave with the subsets of the scene, so one sorted run over them serves all
    subsets and areas. ``use`` makes further columns by (subset, area) of the stored rows with ``more`` and of the names of subsets.
    """
    area = F.element_at(F.array(*(F.lit(n) for n, _, _ in ranges)), F.col("k") + 1).alias("area")
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    out = None
    for scenes, number, n in numbers(of):
        rows = stored(M.judged(dets, gts, scenes, ranges, max_det, choose, 1, more))
        ap = M.judged_ap(rows, len(ranges), n, M.score_bounds(rows.filter("rank >= 0"))).join(number, "at")
        part = ap.groupBy("subset", area).agg(F.sum("npig").alias("n_gt"), F.count("*").alias("n_categories"), mean(M.mean_of(F.col("aps")), "ap"), mean(F.get("aps", F.lit(0)), "ap50"), mean(F.get("aps", F.lit(5)), "ap75"))
        part = part if use is None else part.join(use(rows, number), ["subset", "area"], "full_outer")
        out = part if out is None else out.unionByName(part)
    return out


def recall(dets: DataFrame, gts: DataFrame, of: DataFrame, max_dets: tuple[int, ...], by_category: bool, least: float | None = None) -> DataFrame:
    """(subset, use_cats, threshold, max_det, ar) of detections with a score of ``least`` or more."""
    d = dets if least is None else dets.filter(F.col("score") >= least)
    match = M.packed(d, gts, by_category, max_det=max(max_dets)).join(of, "scene_id")
    counts = M.gt_counts(gts if by_category else gts.withColumn("gt_label", F.lit(0))).join(of, "scene_id")
    out = None
    for k in max_dets:
        part = M.average_recall(match, counts, k, ["subset"])
        out = part if out is None else out.unionByName(part)
    return out.select("subset", F.lit(by_category).alias("use_cats"), F.lit(least).cast("double").alias("threshold"), "max_det", "ar")


def _by_area(rows: DataFrame) -> DataFrame:
    """Rows with (subset, abin), once for their area and once for all."""
    name = F.element_at(F.array(*(F.lit(a) for a in AREAS)), F.col("abin") + 1)
    return rows.withColumn("area", F.explode(F.array(F.lit("all"), name)))


def _size(x: dict) -> np.ndarray:
    return (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])


def assigned(det: dict, gt: dict, least: float = 0.5, below: float = 0.1) -> tuple[list[np.ndarray], dict]:
    """The masks of ``oracle_assign`` and ``distractors``, for ``precision``, with what they say: known (assigned) or not, hit (the label is the box's; -1 where either has none), abin.

    Known masks are in the area of their ground truth, distractors in their own. Ground truth that is a crowd is an ignore zone.
    """
    n = len(det["scene"])
    known, hit, abin, free = np.full(n, -1), np.full(n, -1), np.digitize(np.nan_to_num(_size(det), nan=np.inf), (1024.0, 2048.0)), np.ones(n, bool)
    box = np.flatnonzero(~gt["crowd"])[np.argsort(gt["no"][~gt["crowd"]], kind="stable")]
    sides = [np.stack([x[c] for c in N.BOX]) for x in (gt, det)]
    size, near = [_size(gt), _size(det)], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for own in (box, np.flatnonzero(gt["crowd"])):
        for i, j in pairs_within(gt["scene"][own], det["scene"]):
            i = own[i]
            for low in (0, 1):
                meet = (sides[0][low][i] < sides[1][low + 2][j]) & (sides[1][low][j] < sides[0][low + 2][i])
                i, j = i[meet], j[meet]
            if own is not box:
                free[j] = False
                continue
            g, m = sides[0][:, i], sides[1][:, j]
            both = (np.minimum(g[2], m[2]) - np.maximum(g[0], m[0])) * (np.minimum(g[3], m[3]) - np.maximum(g[1], m[1]))
            iou = both / (size[0][i] + size[1][j] - both)
            free[j[iou >= below]] = False
            near.append((i[iou >= least], j[iou >= least], iou[iou >= least]))
    i, j, iou = (np.concatenate(c) for c in zip(*near, strict=True))
    taken: set[int] = set()
    place = np.lexsort((det["no"][j], gt["no"][i], -iou))  # scenes take nothing from one another
    for a, b in zip(i[place].tolist(), j[place].tolist(), strict=True):
        if known[b] < 0 and a not in taken:
            taken.add(a)
            known[b] = 1
            label, true = det["cat"][b], gt["cat"][a]
            hit[b] = int(label == true) if label == label and true == true else -1
            abin[b] = np.digitize(size[0][a], (1024.0, 2048.0))
    free &= known < 0
    known[free] = 0
    return [known >= 0], {"known": known, "hit": hit, "abin": abin}


def answers(rows: DataFrame, number: DataFrame) -> DataFrame:
    """(subset, area, n_oracle, top1, n_known, n_unknown, auroc) of the stored rows of ``assigned``, counted by subsets, area and score before they are met by each subset and area."""
    each = rows.filter("rank >= 0 AND known >= 0").groupBy("sub", "abin", "score").agg(F.count_if(F.expr("known = 1")).alias("p"), F.count_if(F.expr("known = 0")).alias("n"), F.count_if(F.expr("hit = 1")).alias("right"), F.count_if(F.expr("hit >= 0")).alias("said"))
    each = stored(_by_area(each).join(number, F.expr("shiftright(sub, CAST(at AS INT)) & 1 = 1")).groupBy("subset", "area", "score").agg(*(F.sum(c).alias(c) for c in ("p", "n", "right", "said"))))
    top = each.groupBy("subset", "area").agg(F.sum("p").alias("n_oracle"), F.round(F.try_divide(F.sum("right"), F.sum("said")), 9).alias("top1"), F.sum("p").alias("n_known"), F.sum("n").alias("n_unknown"))
    side = lambda c, positive: each.filter(f"{c} > 0").select("subset", "area", F.col("score").alias("s"), F.lit(positive).alias("positive"), F.col(c).alias("times"))
    auroc = M.auroc(side("p", True).unionByName(side("n", False)), ["subset", "area"], "times")
    return top.join(auroc.withColumn("auroc", F.round("auroc", 9)), ["subset", "area"])


def evaluate_oracle(masks: DataFrame, truth: DataFrame, of: DataFrame, ranges: tuple) -> DataFrame:
    """Precision of the oracle-selected masks, top-1 and AUROC, a row for each subset and area; masks are assigned where they are matched."""
    return precision(masks.withColumnRenamed("mask_no", "det_no"), truth, of, ranges, choose=assigned, more="known int, hit int, abin int", use=answers)


def evaluate_baseline(masks: DataFrame, truth: DataFrame, of: DataFrame, ranges: tuple, choose: Callable = M.every_mask) -> DataFrame:
    """Precision of all masks, or of those that ``choose`` takes, a row for each subset and area."""
    return precision(masks.withColumnRenamed("mask_no", "det_no"), truth, of, ranges, choose=choose)


def selected(det: dict, gt: dict) -> tuple[list[np.ndarray], dict]:
    """The masks of the selection, for ``precision``."""
    return [N.chosen_of(det["no"], np.stack([det[c] for c in N.BOX], axis=1), scene=det["scene"])[0]], {}


def recall_variants(masks: DataFrame, truth: DataFrame, of: DataFrame, max_dets: tuple[int, ...] = (1, 10, 100), least: float = 0.4) -> DataFrame:
    """Average recall with and without categories, with and without a bound on the score.

    Detections of lower scores take nothing from those before them, so the matches above a bound are those without one, and one matching serves both and all ``max_dets``.
    """
    dets, out = masks.withColumnRenamed("mask_no", "det_no"), None
    variants = [(bound, k) for bound in (None, least) for k in max_dets]
    right = F.bit_count(F.col("hits").bitwiseAND(F.bitwise_not("skips")))
    for by_category in (False, True):
        match = M.packed(dets, truth, by_category, max_det=max(max_dets)).join(of, "scene_id")
        taken = [(F.col("rank") < k) & (F.lit(True) if bound is None else F.col("score") >= bound) for bound, k in variants]
        tp = match.groupBy("subset", "cat").agg(*(F.sum(F.when(t, right)).alias(f"t{i}") for i, t in enumerate(taken)))
        n = M.gt_counts(truth if by_category else truth.withColumn("gt_label", F.lit(0))).join(of, "scene_id").groupBy("subset", "cat").agg(F.sum("n").alias("n"))
        each = F.explode(F.array(*(F.struct(F.lit(bound).cast("double").alias("threshold"), F.lit(k).alias("max_det"), F.coalesce(f"t{i}", F.lit(0)).alias("tp")) for i, (bound, k) in enumerate(variants)))).alias("v")
        r = n.join(tp, ["subset", "cat"], "left").select("subset", "n", each).select("subset", "v.threshold", "v.max_det", (F.col("v.tp") / F.col("n") / len(M.IOU_THRESHOLDS)).alias("r"))
        part = r.groupBy("subset", "threshold", "max_det").agg(F.round(F.avg("r"), 9).alias("ar")).select("subset", F.lit(by_category).alias("use_cats"), "threshold", "max_det", "ar")
        out = part if out is None else out.unionByName(part)
    return out


def recall_summary(best: DataFrame, of: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(subset, area, n_gt, recall_50, recall_75, recall_50_95) of best (scene_id, gt_area, best_iou), with 95 % intervals from weights (b, scene_id, w).

    An interval resamples the scenes of the whole table, so scenes outside a subset weigh nothing in it.
    """
    rows = _by_area(best.withColumn("abin", area_bin(F.col("gt_area"))).join(of, "scene_id"))
    hit = [F.count_if(F.col("best_iou") >= float(t)).alias(f"h{i}") for i, t in enumerate(M.IOU_THRESHOLDS)]
    per = rows.groupBy("subset", "area", "scene_id").agg(F.count("*").alias("n"), *hit)
    names = {"recall_50": "h0", "recall_75": "h5", "recall_50_95": " + ".join(f"h{i}" for i in range(10))}
    ratio = lambda w: [F.expr(f"try_divide(sum({w} * ({c})), sum({w} * n) * {10 if ' ' in c else 1})").alias(k) for k, c in names.items()]
    point = per.groupBy("subset", "area").agg(F.sum("n").alias("n_gt"), *ratio("1"))
    point = point.select("subset", "area", "n_gt", *(F.round(k, 9).alias(k) for k in names))
    if weights is None:
        return point
    boot = per.join(weights, "scene_id").groupBy("subset", "area", "b").agg(*ratio("w"))
    ends = boot.groupBy("subset", "area").agg(*(F.round(F.percentile(k, F.lit(q)), 6).alias(f"{k}_{n}") for k in names for n, q in (("lo", 0.025), ("hi", 0.975))))
    return point.join(ends, ["subset", "area"], "left")
