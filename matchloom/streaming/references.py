"""Reference images to gallery rows as a stream: crops, encoding, and an append that a restart repeats without harm.

A batch is appended and noted in one commit of the gallery's manifest. If the application ends before that, the batch is
in no version and is run again; if it ends after that but before Spark notes the batch, Spark repeats the batch and the manifest's note
makes it do nothing. References that the gallery holds already, from another stream, are not encoded again.

Defined results: rows without ref_id, label, box or image are an error of the batch that holds them; a reference that a batch repeats counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..operators.seam import Encoder, encode
from ..sources.files import must
from ..sources.versions import Gallery

ROW = "ref_id long, label_id int, image string, box array<double>, height int, width int, channels int, data binary"


def crops(rows: DataFrame, filler: str = "0", factor: float = 1.0, size: int = I.CROP) -> DataFrame:
    """(image, ref_id, label_id, height, width, channels, data) of the crops around the boxes of ROW; the box stands for the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a crop at a time: images are large
                one = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                image = np.frombuffer(one["data"], np.uint8).reshape(one["height"], one["width"], one["channels"])
                image = np.repeat(image, 3, axis=2) if one["channels"] == 1 else image[:, :, :3]
                x0, y0, x1, y1 = one["box"]
                inside = lambda l, t, r, u: ((np.arange(t, u) >= y0) & (np.arange(t, u) < y1))[:, None] & ((np.arange(l, r) >= x0) & (np.arange(l, r) < x1))[None, :]  # noqa: E731, B023
                made = I.crop(image, (x0, y0, x1, y1), inside, filler, factor, size)
                yield pa.RecordBatch.from_pylist([{"image": one["image"], "ref_id": one["ref_id"], "label_id": one["label_id"], "height": size, "width": size, "channels": 3, "data": made.tobytes()}], schema)

    schema = pa.schema([("image", pa.string()), ("ref_id", pa.int64()), ("label_id", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
    whole = F.col("ref_id").isNotNull() & F.col("label_id").isNotNull() & F.col("box").isNotNull() & F.col("data").isNotNull()
    sound = rows.withColumn("ref_id", must(whole, F.col("ref_id"), "reference without id, label, box or image"))
    names = [c.split()[0] for c in ROW.split(", ")]
    return sound.select(*names).mapInArrow(run, "image string, ref_id long, label_id int, height int, width int, channels int, data binary")


def encoded(rows: DataFrame, encoder: Encoder, filler: str = "0", factor: float = 1.0, size: int = I.CROP, batch: int = 16) -> DataFrame:
    """(ref_id, label_id, z) of ROW: crops, encoded in order within each image, ``batch`` at a time."""
    return encode(crops(rows, filler, factor, size), encoder, "image", "ref_id", ["label_id"], batch).select("ref_id", "label_id", "z")


def build(stream: DataFrame, path: str, expect: dict, encoder: Encoder, name: str, checkpoint: str, **how) -> Gallery:
    """Appends all references that a stream of ROW holds now to the gallery at ``path``, batch by batch; ``how`` goes to ``encoded``."""
    spark = stream.sparkSession

    def step(df: DataFrame, number: int) -> None:
        g = Gallery.open(spark, path, expect)
        if g.manifest.get("streams", {}).get(name, -1) >= number:
            return
        fresh = df.dropDuplicates(["ref_id"]).join(g.all_rows().select("ref_id"), "ref_id", "left_anti")
        g.append(encoded(fresh, encoder, **how), (name, number))

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start().awaitTermination()
    return Gallery.open(spark, path, expect)
