"""Box algebra on (scene_id, x0, y0, x1, y1): every join is an equi-join on the scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def area(a: str) -> Column:
    c = lambda n: F.col(f"{a}.{n}")
    return (c("x1") - c("x0")) * (c("y1") - c("y0"))


def inter(a: str, b: str) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Null where both boxes are empty."""
    i = inter(a, b)
    return F.try_divide(i, area(a) + area(b) - i)


def overlap(a: str, b: str) -> Column:
    """Range predicates that boxes with a common pixel satisfy."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x0") < c(b, "x1")) & (c(b, "x0") < c(a, "x1")) & (c(a, "y0") < c(b, "y1")) & (c(b, "y0") < c(a, "y1"))


def pairs(gt: DataFrame, masks: DataFrame, least: float = 0.0) -> DataFrame:
    """Overlapping (scene_id, gt_no, mask_no) with iou, inter and areas; pairs that do not touch have IoU 0 and are left out."""
    on = (F.col("g.scene_id") == F.col("m.scene_id")) & overlap("g", "m")
    out = gt.alias("g").join(masks.alias("m"), on).select(
        "g.scene_id", "g.gt_no", "g.gt_label", "m.mask_no", "m.label_id", iou("g", "m").alias("iou"), inter("g", "m").alias("inter"), area("g").alias("gt_area"), area("m").alias("mask_area"),
    )
    return out.filter(F.col("iou") >= least) if least else out


def best_per_gt(gt: DataFrame, masks: DataFrame) -> DataFrame:
    """Largest IoU of each ground-truth box, 0 without a mask."""
    best = pairs(gt, masks).groupBy("scene_id", "gt_no").agg(F.max("iou").alias("best"))
    g = gt.alias("g").join(best.alias("b"), ["scene_id", "gt_no"], "left")
    return g.select("scene_id", "gt_no", "gt_label", area("g").alias("gt_area"), F.coalesce("best", F.lit(0.0)).alias("best_iou"))


def area_bin(a: Column, edges: tuple[float, float] = (1024.0, 2048.0)) -> Column:
    """Half-open bins: an area on an edge belongs to the next bin."""
    return F.when(a < edges[0], 0).when(a < edges[1], 1).otherwise(2)


def distractors(gt: DataFrame, masks: DataFrame, zones: DataFrame | None = None, below: float = 0.1) -> DataFrame:
    """Masks with every IoU below the bound; without ground truth all; touching an ignore zone never."""
    top = pairs(gt, masks).groupBy("scene_id", "mask_no").agg(F.max("iou").alias("top"))
    out = masks.join(top, ["scene_id", "mask_no"], "left").filter(F.coalesce("top", F.lit(0.0)) < below)
    if zones is not None:
        on = (F.col("m.scene_id") == F.col("z.scene_id")) & overlap("m", "z")
        out = out.alias("m").join(zones.alias("z"), on, "left_anti")
    return out.select("scene_id", "mask_no")


def nearest_gt(gt: DataFrame, masks: DataFrame, least: float = 0.1) -> DataFrame:
    """The ground-truth box of largest IoU of each mask near one; ties to the smaller gt_no."""
    w = Window.partitionBy("scene_id", "mask_no").orderBy(F.desc("iou"), "gt_no")
    return pairs(gt, masks, least).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("scene_id", "mask_no", "gt_no", "iou")


def inside(gt: DataFrame, masks: DataFrame, part: float = 0.9, size: float = 0.05) -> DataFrame:
    """Ground-truth boxes and whether a mask lies in them: inter >= part of the mask, mask >= size of the box."""
    hit = pairs(gt, masks).filter((F.col("inter") >= part * F.col("mask_area")) & (F.col("mask_area") >= size * F.col("gt_area")))
    hit = hit.select("scene_id", "gt_no").distinct().withColumn("inside", F.lit(True))
    return gt.join(hit, ["scene_id", "gt_no"], "left").select("scene_id", "gt_no", F.coalesce("inside", F.lit(False)).alias("inside"))


def square(x0: Column, y0: Column, x1: Column, y1: Column, factor: Column | float) -> Column:
    """Square crop around a box: side is the longer side times factor, banker's rounding."""
    side = F.bround(F.greatest(x1 - x0, y1 - y0) * factor).cast("long")
    left = F.bround((x0 + x1 - side) / 2).cast("long")
    top = F.bround((y0 + y1 - side) / 2).cast("long")
    return F.struct(left.alias("x"), top.alias("y"), side.alias("side"))
