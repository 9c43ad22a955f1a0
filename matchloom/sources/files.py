"""Data sets as folders: listings of references and scenes, annotations, ignore zones, decoded images.

Listings read file names only (contents are pruned from the scan), so they work on any store Spark reads.
Defined results: an empty folder gives no rows; files of other kinds are ignored; what a data set forbids
(unpaired views, a wrong class, a missing clean image) is an error when rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.images import grey, mask_box
from .voc import SCHEMA

# Classes and boards of the board data set.
CLASSES = ("Missing_hole", "Mouse_bite", "Open_circuit", "Short", "Spur", "Spurious_copper")
BOARDS = {"gallery": ("01", "04"), "cal": ("09", "10"), "test": ("05", "06", "07", "08", "11", "12")}


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path of every file below root whose name matches a glob, relative to root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.regexp_replace("path", rf"^.*?/?\Q{base}\E/", "").alias("path"))


def must(cond: Column, value: Column, message: str) -> Column:
    """value, or an error where cond does not hold."""
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def rsplit(text: Column, by: str) -> Column:
    """(before, after) the last ``by``; before is empty without one."""
    return F.struct(F.regexp_extract(text, rf"^(.*)\Q{by}\E", 1).alias("before"), F.substring_index(text, by, -1).alias("after"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def references(spark: SparkSession, root: str, views: int) -> DataFrame:
    """(id, label, category_id, image, mask) of Objects/<label>/images/*.jpg, each paired with its mask; labels in sorted order."""
    got = listing(spark, f"{root}/Objects", "*.{jpg,png}")
    kind = F.regexp_extract("path", r"^[^/]+/([^/]+)/", 1)
    f = got.select(F.regexp_extract("path", r"^([^/]+)/", 1).alias("label"), stem(F.col("path")).alias("view"), kind.alias("kind"), F.concat(F.lit("Objects/"), "path").alias("path"))
    image = f.filter("kind = 'images' AND path LIKE '%.jpg'").select("label", "view", F.col("path").alias("image"))
    mask = f.filter("kind IN ('mask', 'masks') AND path LIKE '%.png'").groupBy("label", "view").agg(F.min_by("path", F.col("kind") != "masks").alias("mask"))
    pairs = image.join(mask, ["label", "view"], "full_outer")
    n = F.count("*").over(Window.partitionBy("label"))
    ok = F.col("image").isNotNull() & F.col("mask").isNotNull() & (F.col("_n") == views)
    pairs = pairs.withColumn("_n", n).withColumn("image", must(ok, F.col("image"), f"views and masks do not form {views} pairs"))
    ids = pairs.select("label").distinct().withColumn("category_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    return pairs.join(F.broadcast(ids), "label").select(F.concat_ws("/", "label", "view").alias("id"), "label", "category_id", "image", "mask")


def scenes(spark: SparkSession, root: str) -> DataFrame:
    """(id, level, room, image, xml) of Scenes/<level>/<room>/*.xml."""
    p = listing(spark, f"{root}/Scenes", "*.xml").filter(r"path RLIKE '^[^/]+/[^/]+/[^/]+\\.xml$'")
    room = rsplit(F.col("path"), "/")["before"]
    return p.select(F.concat_ws("/", room, stem(F.col("path"))).alias("id"), F.substring_index("path", "/", 1).alias("level"), room.alias("room"), F.concat(F.lit("Scenes/"), F.regexp_replace("path", r"\.xml$", ".jpg")).alias("image"), F.concat(F.lit("Scenes/"), "path").alias("xml"))


def annotations(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """rows (with xml, a path) and the parsed annotation: filename, wh, objects (name, box)."""
    text = spark.read.text(root, wholetext=True, pathGlobFilter="*.xml", recursiveFileLookup=True)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    text = text.select(F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?/?\Q{base}\E/", "").alias("xml"), F.from_xml("value", F.lit(SCHEMA)).alias("a"))
    box = lambda o: F.array(*(o["bndbox"][n].cast("int") for n in ("xmin", "ymin", "xmax", "ymax")))
    parsed = text.select("xml", "a.filename", F.array("a.size.width", "a.size.height").alias("wh"), F.transform("a.object", lambda o: F.struct(o["name"].alias("name"), box(o).alias("box"))).alias("objects"))
    return rows.join(parsed, "xml")


def board_images(spark: SparkSession, root: str) -> DataFrame:
    """(id, board, label, image, xml) of Annotations/<class>/*.xml; the board is what stands before the first '_'."""
    p = listing(spark, f"{root}/Annotations", "*.xml").filter(r"path RLIKE '^[^/]+/[^/]+\\.xml$'")
    label, name = F.substring_index("path", "/", 1), stem(F.col("path"))
    known = p.filter(label.isin(*CLASSES))
    return known.select(name.alias("id"), F.substring_index(name, "_", 1).alias("board"), label.alias("label"), F.concat(F.lit("images/"), label, F.lit("/"), name, F.lit(".jpg")).alias("image"), F.concat(F.lit("Annotations/"), "path").alias("xml"))


def board_truth(spark: SparkSession, root: str, images: DataFrame) -> DataFrame:
    """(id, board, label, category_id, image, no, box, iscrowd): boxes whose file name and class agree with the folder, else an error."""
    a = annotations(spark, root, images).select("*", F.posexplode("objects").alias("no", "o"))
    cid = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("label")) - 1
    ok = (F.col("filename") == F.substring_index("image", "/", -1)) & (F.col("o.name") == F.lower("label"))
    return a.select("id", "board", "label", cid.cast("int").alias("category_id"), "image", "no", must(ok, F.col("o.box"), "annotation of another file or class").alias("box"), F.lit(False).alias("iscrowd"))


def board_references(spark: SparkSession, root: str) -> DataFrame:
    """Reference boxes of the gallery boards; the id is <image>/<number of the box>."""
    g = board_truth(spark, root, board_images(spark, root).filter(F.col("board").isin(*BOARDS["gallery"])))
    return g.select(F.concat_ws("/", "id", F.col("no").cast("string")).alias("id"), "label", "category_id", "image", "board", "box")


def ignore_zones(spark: SparkSession, path: str) -> DataFrame:
    """(id, box) of the candidates of a check report, of the test boards only."""
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", "unlabeled_by_diff struct<candidates:map<string,array<array<int>>>>").alias("j"))
    z = j.select(F.explode("j.unlabeled_by_diff.candidates").alias("id", "zones")).select("id", F.explode("zones").alias("box"))
    return z.filter(F.substring_index("id", "_", 1).isin(*BOARDS["test"]))


def truth_with_zones(truth: DataFrame, images: DataFrame, zones: DataFrame) -> DataFrame:
    """Truth of test boards and their zones as crowds of the image's class; an image of another board is an error."""
    board = must(F.col("board").isin(*BOARDS["test"]), F.col("board"), "not a test board")
    cid = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("label")) - 1
    z = zones.join(images, "id").select("id", "board", "label", cid.cast("int").alias("category_id"), "image", F.lit(-1).alias("no"), "box", F.lit(True).alias("iscrowd"))
    return truth.unionByName(z).withColumn("board", board)


def clean_image(spark: SparkSession, root: str, board: str) -> str:
    """The faultless image of a board, relative to root; an error if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/PCB_USED/{board}.JPG")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{root}/PCB_USED/{board}.JPG")
    return f"PCB_USED/{board}.JPG"


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, channels, data) of all images Spark decodes; data are rows of pixels, blue, green, red."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").withColumnRenamed("origin", "path")


def reference_masks(decoded: DataFrame) -> DataFrame:
    """(path, hw, area, box) of mask images: the foreground is what is lighter than 127 in grey; an empty mask is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, h, w, c, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                m = grey(np.frombuffer(data, np.uint8).reshape(h, w, c)) > 127
                rows.append({"path": path, "hw": [h, w], "area": int(m.sum()), "box": mask_box(m)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("hw", pa.list_(pa.int32())), ("area", pa.int64()), ("box", pa.list_(pa.int32()))]))

    return decoded.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, hw array<int>, area long, box array<int>")
