"""VOC annotations as XML text: one document per scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "filename STRING, size STRUCT<width INT, height INT>, object ARRAY<STRUCT<name STRING, bndbox STRUCT<xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE>>>"


def render(gt: DataFrame) -> DataFrame:
    """One column ``xml`` per scene of (scene_id, gt_no, gt_label, box)."""
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v.cast("string"), F.lit(f"</{n}>"))
    box = F.concat(F.lit("<bndbox>"), tag("xmin", F.col("x0")), tag("ymin", F.col("y0")), tag("xmax", F.col("x1")), tag("ymax", F.col("y1")), F.lit("</bndbox>"))
    obj = F.concat(F.lit("<object>"), tag("name", F.col("gt_label")), box, F.lit("</object>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt_no", obj.alias("o")))), lambda s: s["o"]), "")
    return gt.groupBy("scene_id").agg(F.concat(F.lit("<annotation>"), tag("filename", F.first("scene_id")), F.lit("<size><width>700</width><height>600</height></size>"), body, F.lit("</annotation>")).alias("xml"))


def parse(xml: DataFrame) -> DataFrame:
    """filename, pos, name and whole-number boxes of every object; coordinates are cut to integers, toward zero."""
    p = xml.select(F.from_xml("xml", F.lit(SCHEMA)).alias("a")).select("a.filename", F.posexplode("a.object").alias("pos", "o"))
    return p.select("filename", "pos", "o.name", *(F.col(f"o.bndbox.{n}").cast("int").alias(m) for n, m in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))))


def with_rules(objects: DataFrame, rename: dict[str, str], drop: list[str], labels: list[str]) -> DataFrame:
    """Objects with names renamed, dropped ones out, and an error for names that are not labels."""
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in rename.items() for x in kv)), F.col("name")), F.col("name")) if rename else F.col("name")
    known = F.array(*(F.lit(x) for x in labels))
    out = objects.withColumn("name", name).filter(~F.col("name").isin(*drop) if drop else F.lit(True))
    return out.withColumn("category_id", F.when(F.assert_true(F.array_contains(known, F.col("name")), F.lit("unknown object name")).isNull(), F.array_position(known, F.col("name")) - 1))
