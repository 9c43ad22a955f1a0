"""Checks of image data: a profile of every file in one pass, and where boards differ from their clean image beyond what is annotated.

Defined results: files that do not decode have no size and no channels; masks without foreground have no box; an image of another
size than the clean one is an error; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regions as RG
from ..functions.images import grey, mask_box

PROFILE = "path string, height int, width int, channels int, levels int, between long, foreground double, box array<int>"
REGION = "id string, board string, x0 int, y0 int, x1 int, y1 int, area long"
CELL, MOST = 20, 20  # fixed values: side of a cell in which regions repeat, regions above which an image is out of place


def files(spark: SparkSession, root: str, pattern: str = "*.{jpg,png,JPG}") -> DataFrame:
    """(path, length, md5, ends, trailer) of all files below root: whether JPEG data end as they should, and what stands between the end mark and the last two bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    back = F.locate("\u00d9\u00ff", F.reverse(F.decode("content", "ISO-8859-1")))  # a character a byte: the last end mark, from the end
    after = F.when(back > 0, F.length("content") - back - 1)
    photo = F.lower(F.substring_index("path", ".", -1)) == "jpg"
    end = F.length("content")
    trailer = F.when(photo, F.when(end - after > 2, F.decode(F.substring("content", -8, 6), "ISO-8859-1")).otherwise(""))
    return f.select("path", "length", F.md5("content").alias("md5"), F.when(photo, F.coalesce(after > 0, F.lit(False))).alias("ends"), trailer.alias("trailer"))


def shapes(decoded: DataFrame) -> DataFrame:
    """PROFILE of decoded images (path, height, width, channels, data): size, and of grey levels how many there are, how many pixels are neither black nor white, and what is lighter than 127."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("levels", pa.int32()), ("between", pa.int64()), ("foreground", pa.float64()), ("box", pa.list_(pa.int32()))])
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                path, h, w, c, data = (x[i].as_py() for x in b.columns)
                if data is None or h is None or h <= 0:
                    rows.append({"path": path})
                    continue
                g = grey(np.frombuffer(data, np.uint8).reshape(h, w, c))
                front = g > 127
                rows.append({"path": path, "height": h, "width": w, "channels": c, "levels": len(np.unique(g)), "between": int(((g > 0) & (g < 255)).sum()), "foreground": float(front.mean()), "box": mask_box(front) if front.any() else None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return decoded.select("path", "height", "width", "channels", "data").mapInArrow(run, PROFILE)


def repeated(profile: DataFrame) -> DataFrame:
    """(md5, n, first) of contents that several files have."""
    return profile.groupBy("md5").agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1")


def differences(images: DataFrame, clean: DataFrame) -> DataFrame:
    """REGION rows: where images (id, board, height, width, channels, data) differ from the clean image of their board (board, height, width, channels, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                one = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                shape = one["height"], one["width"], one["channels"]
                if shape != (one["clean_height"], one["clean_width"], one["clean_channels"]):
                    raise ValueError(f"{one['id']} has another size than the clean image of board {one['board']}")
                box, area, _ = RG.changes(*(np.frombuffer(one[c], np.uint8).reshape(shape) for c in ("data", "clean_data")))
                rows += [{"id": one["id"], "board": one["board"], "x0": x0, "y0": y0, "x1": x1, "y1": y1, "area": a} for (x0, y0, x1, y1), a in zip(box.tolist(), area.tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.string()), ("board", pa.string()), *((c, pa.int32()) for c in ("x0", "y0", "x1", "y1")), ("area", pa.int64())]))

    own = clean.select("board", *(F.col(c).alias(f"clean_{c}") for c in ("height", "width", "channels", "data")))
    both = images.select("id", "board", "height", "width", "channels", "data").join(own, "board")
    names = ["id", "board", "height", "width", "channels", "data", "clean_height", "clean_width", "clean_channels", "clean_data"]
    return both.select(*names).mapInArrow(run, REGION)


def unlabelled(regions: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions that touch no box, boxes that no region touches) of regions (id, board, box) and boxes (id, no, x0, y0, x1, y1).

    Images with over ``MOST`` such regions are out of place and give none; regions that repeat at one place of a board, by cells of ``CELL`` pixels, are
    the clean image's own and are left out.
    """
    r, b = regions.alias("r"), boxes.alias("b")
    meet = (F.col("r.id") == F.col("b.id")) & (F.col("r.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("r.x1")) & (F.col("r.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("r.y1"))
    outside = r.join(b, meet, "left_anti")
    crowded = outside.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > MOST)
    outside = outside.join(crowded, "id", "left_anti").withColumn("cx", F.expr(f"x0 div {CELL}")).withColumn("cy", F.expr(f"y0 div {CELL}"))
    single = outside.groupBy("board", "cx", "cy").agg(F.count("*").alias("n")).filter("n = 1").select("board", "cx", "cy")
    return outside.join(single, ["board", "cx", "cy"], "left_semi").drop("cx", "cy"), b.join(r, meet, "left_anti")
