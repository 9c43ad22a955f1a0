"""Work stores: results kept under the key of what they depend on, so what exists is done and other settings are refused.

A store is a folder of Parquet written by Spark's committer; its key is one line of JSON beside the rows.
Defined results: a store that was never written is empty; a row saved twice is kept twice (save ``todo`` rows only);
rows with null ids are refused, as are vectors that are not finite.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, digest, key_of
from . import gallery as GA

EMBEDDINGS = "image_id string, mask_no long, empty boolean, z array<float>"
MASKS = "image_id string, mask_no long, hw array<int>, rle struct<size:array<int>,counts:string>, box array<double>, score double"
FORMAT = 1


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Store:
    """Rows of one schema under one configuration."""

    def __init__(self, spark: SparkSession, folder: str, config: dict, schema: str):
        self.spark, self.folder, self.config, self.schema = spark, folder.rstrip("/"), json.loads(canonical(config)), schema
        self.key = digest(self.config)

    def _check(self, make: bool = False) -> bool:
        """Whether the store exists; an error if it was written under another configuration."""
        path = f"{self.folder}/key"
        if not _exists(self.spark, path):
            if make:
                self.spark.createDataFrame([(canonical(self.config),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
            return make
        held = json.loads(self.spark.read.text(path).collect()[0][0])  # one line
        if held != self.config:
            raise ValueError(f"{self.folder} was written under another configuration")
        return True

    def save(self, rows: DataFrame) -> None:
        names = [f.name for f in self.load().schema]
        ok = F.col("image_id").isNotNull() & F.col("mask_no").isNotNull()
        if "z" in names:
            ok = ok & GA.finite(F.col("z"))
        self._check(make=True)
        sound = F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("row without id, or vector that is not finite"))
        rows.select(*names).filter(sound.isNull()).withColumn("key", F.lit(self.key)).write.mode("append").parquet(f"{self.folder}/rows")

    def load(self) -> DataFrame:
        """All rows; those of another key are an error."""
        if not (self._check() and _exists(self.spark, f"{self.folder}/rows")):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, key string").parquet(f"{self.folder}/rows")
        return rows.filter(F.assert_true(F.col("key") == self.key, F.lit("row of another configuration")).isNull()).drop("key")

    def done(self) -> DataFrame:
        return self.load().select("image_id").distinct()

    def todo(self, images: DataFrame) -> DataFrame:
        return GA.todo(images, self.done(), ["image_id"])

    def log(self, rows: DataFrame) -> None:
        """Appends lines about the work; they are no part of the key."""
        self._check(make=True)
        rows.write.mode("append").json(f"{self.folder}/progress")

    def progress(self) -> DataFrame | None:
        path = f"{self.folder}/progress"
        return self.spark.read.json(path) if _exists(self.spark, path) else None


def embeddings(spark: SparkSession, folder: str, config: dict) -> Store:
    return Store(spark, folder, config, EMBEDDINGS)


def masks(spark: SparkSession, folder: str, config: dict) -> Store:
    return Store(spark, folder, config, MASKS)


def check_calibration(rec: dict, eps: tuple[float, ...], keep: int = 200_000, points: int = 10_001) -> None:
    """Raises where a calibration record breaks its form."""
    f = rec.get("F", {})
    top, grid = f.get("top", []), f.get("quantiles", [])
    falls = lambda x: all(a >= b for a, b in zip(x, x[1:], strict=False))
    rules = {
        "fields": all(k in rec for k in ("format", "N0", "F", "delta", "check_set_ids", "by_eps", "gallery_rows", "gallery_rows_sha256")),
        "format": rec.get("format") == FORMAT and rec.get("N0", 0) > 0 and rec.get("delta", 0) > 0,
        "top": 0 < len(top) <= min(keep, f.get("n_pairs", 0)) and falls(top),
        "quantiles": len(grid) == points and falls(grid[::-1]) and bool(top) and grid[-1] == top[0],
        "levels": set(rec.get("by_eps", {})) == {key_of(e) for e in eps},
        "values": all(set(r) >= {"tau_q", "tau_m", "kappa"} and r["kappa"] is not None and 0 < r["kappa"] <= 1 for r in rec.get("by_eps", {}).values()),
    }
    if broken := [k for k, ok in rules.items() if not ok]:
        raise ValueError(f"calibration record: {', '.join(broken)}")


def write_calibration(rows: DataFrame, path: str, tail: dict, by_eps: dict[float, dict], delta: float, check_ids: list[str], protocol: str = "full", points: int = 10_001) -> dict:
    """Stores thresholds and ``calibration.tail_record`` with the hash of the gallery rows they were set for; never overwrites."""
    rec = {"format": FORMAT, "N0": rows.count(), "F": tail, "delta": delta, "check_set_ids": check_ids, "by_eps": {key_of(e): {k: r[k] for k in ("tau_q", "tau_m", "kappa")} for e, r in by_eps.items()}, "gallery_rows": protocol, "gallery_rows_sha256": GA.rows_sha256(rows)}
    check_calibration(rec, tuple(by_eps), points=points)
    rows.sparkSession.createDataFrame([(canonical(rec),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return rec


def read_calibration(rows: DataFrame, path: str, eps: tuple[float, ...], protocol: str = "full", points: int = 10_001) -> dict:
    """The stored thresholds; an error if the gallery rows are not those they were set for."""
    rec = json.loads(rows.sparkSession.read.text(path, wholetext=True).collect()[0][0])
    check_calibration(rec, eps, points=points)
    if rec["gallery_rows"] != protocol or rec["N0"] != rows.count() or rec["gallery_rows_sha256"] != GA.rows_sha256(rows):
        raise ValueError(f"thresholds were set for other rows than these ({rec['gallery_rows']}, asked for {protocol})")
    return rec


def write_kept(rows: DataFrame, kept: DataFrame, path: str, threshold: float, of: str) -> dict:
    """Stores which of a gallery's rows deduplication keeps (label_id, insert_no), with the threshold, the run ``of`` which it is, and hashes of the rows and of those kept; never overwrites."""
    own = kept.select("label_id", "insert_no")
    if own.join(rows.select("label_id", "insert_no"), ["label_id", "insert_no"], "left_anti").limit(1).count():
        raise ValueError("kept rows are not among the gallery's")
    named = rows.join(own, ["label_id", "insert_no"], "left_semi")
    rec = {"format": FORMAT, "threshold": threshold, "of": of, "rows": rows.count(), "kept": named.count(), "rows_sha256": GA.blocks_sha256(rows).collect()[0]["blocks_sha256"], "kept_sha256": GA.blocks_sha256(named).collect()[0]["blocks_sha256"]}
    own.write.mode("errorifexists").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(canonical(rec),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/record")  # last: a torn write has none
    return rec


def read_kept(rows: DataFrame, path: str, threshold: float, of: str) -> DataFrame:
    """The kept rows of a gallery; an error if they were chosen with another threshold, of another run or gallery, or are not those that were written."""
    spark = rows.sparkSession
    if not _exists(spark, f"{path}/record"):
        raise FileNotFoundError(f"{path}: no record of kept rows")
    rec = json.loads(spark.read.text(f"{path}/record", wholetext=True).collect()[0][0])
    if (rec["threshold"], rec["of"]) != (threshold, of) or rec["rows_sha256"] != GA.blocks_sha256(rows).collect()[0]["blocks_sha256"]:
        raise ValueError("kept rows are of another threshold, run or gallery")
    named = rows.join(spark.read.schema("label_id int, insert_no long").parquet(f"{path}/rows"), ["label_id", "insert_no"], "left_semi")
    if named.count() != rec["kept"] or rec["kept_sha256"] != GA.blocks_sha256(named).collect()[0]["blocks_sha256"]:
        raise ValueError("kept rows are not those that were written")
    return named


def dump_config(config: dict) -> str:
    """A flat configuration as YAML: a line for each key, values as JSON, which YAML contains."""
    return "".join(f"{k}: {json.dumps(list(v) if isinstance(v, tuple) else v, ensure_ascii=False)}\n" for k, v in config.items())


def load_config(text: str) -> dict:
    out = {}
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            k, _, v = line.partition(":")
            try:
                out[k.strip()] = json.loads(v.strip())
            except json.JSONDecodeError:  # a bare word
                out[k.strip()] = v.strip().strip("'\"")
    return out
