"""The gallery as a versioned table: part files that never change, and a manifest for each version, committed last.

A folder holds ``parts/<name>`` (Parquet), ``deletes/<name>`` (Parquet of ref_id) and ``manifest/<version>.json``. A version is there once its manifest is: a manifest is
written aside and renamed to a name that must be free, so what a failed write left behind is in no version, and of two
writers that build on the same version one wins and the other gets ``Conflict``.

A manifest lists its parts in insert order with rows, first and last insert number and a hash of their rows (a sum over hashes of the rows, so it
does not depend on their order), the deletes with the same, and the passport: format, dimension, and what the gallery was built
from, by hash. ``open`` compares the passport; ``verify`` reads all parts once and compares rows, hashes, numbers and ids.

Rows: (ref_id, label_id, insert_no, z). Appends number on from the last insert number, deletes only mark, compaction writes what is left as new parts and keeps
the numbers; older versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..plans.cut import cut
from ..plans.numbering import numbered
from .gallery import finite

FORMAT = 1
ROW = "ref_id long, label_id int, insert_no long, z array<float>"
COLUMNS = ["ref_id", "label_id", "insert_no", "z"]
NORM_TOL = 1e-4


class Conflict(RuntimeError):
    """Another writer has committed the next version."""


def passport(config: dict, dim: int, **keys: str) -> dict:
    """What a gallery must have been built with: its dimension, the hash of its configuration, and further keys."""
    return {"format": FORMAT, "dim": dim, "config_sha1": hashlib.sha1(canonical(config).encode()).hexdigest(), **keys}


def _path(spark: SparkSession, uri: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _summary(rows: DataFrame) -> dict:
    """rows, sum of row hashes, first and last insert number where there is one."""
    hashed = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    number = [F.min("insert_no").alias("first"), F.max("insert_no").alias("last")] if "insert_no" in rows.columns else []
    got = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).alias("hash"), *number).collect()[0].asDict()
    return got | {"hash": str(int(got["hash"]))}


@dataclass(frozen=True)
class Gallery:
    """One version of a gallery."""

    spark: SparkSession
    path: str
    manifest: dict

    # ---- versions

    @staticmethod
    def create(spark: SparkSession, path: str, passport: dict) -> Gallery:
        """Version 0, without rows; an error if there is a gallery already."""
        return Gallery._commit(spark, path.rstrip("/"), {"version": 0, "passport": passport, "parts": [], "deletes": []})

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        p, fs = _path(spark, f"{path.rstrip('/')}/manifest")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName()[:-5].isdigit()) if fs.exists(p) else []

    @staticmethod
    def open(spark: SparkSession, path: str, expect: dict | None = None, version: int | None = None) -> Gallery:
        """The last version, or an earlier one; an error if the passport is not the expected one."""
        path = path.rstrip("/")
        have = Gallery.versions(spark, path)
        if not have or version is not None and version not in have:
            raise FileNotFoundError(f"{path}: no version {'' if version is None else version}")
        text = spark.read.text(f"{path}/manifest/{have[-1] if version is None else version:08d}.json", wholetext=True).collect()[0][0]
        manifest = json.loads(text)
        own = manifest["passport"]
        other = [k for k in (expect or {}) if own.get(k) != expect[k]]
        if own.get("format") != FORMAT or other:
            raise ValueError(f"{path}: built with other {', '.join(other) or 'format'}")
        return Gallery(spark, path, manifest)

    @staticmethod
    def _commit(spark: SparkSession, path: str, manifest: dict) -> Gallery:
        jvm = spark.sparkContext._jvm
        p, fs = _path(spark, f"{path}/manifest/{manifest['version']:08d}.json")
        fs.mkdirs(p.getParent())
        aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(canonical(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(p), none)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{path}: version {manifest['version']} has been committed by another writer") from None
            raise
        return Gallery(spark, path, manifest)

    def _next(self, **changes) -> Gallery:
        return Gallery._commit(self.spark, self.path, self.manifest | {"version": self.manifest["version"] + 1} | changes)

    # ---- rows

    @property
    def next_no(self) -> int:
        """The insert number of the next row."""
        return max((p["last"] + 1 for p in self.manifest["parts"]), default=0)

    def all_rows(self) -> DataFrame:
        """All rows with ``deleted``, in as many files as there are."""
        parts = [f"{self.path}/parts/{p['name']}" for p in self.manifest["parts"]]
        rows = self.spark.read.schema(ROW).parquet(*parts) if parts else self.spark.createDataFrame([], ROW)
        marks = [f"{self.path}/deletes/{d['name']}" for d in self.manifest["deletes"]]
        if not marks:
            return rows.withColumn("deleted", F.lit(False))
        gone = self.spark.read.schema("ref_id long").parquet(*marks).distinct().withColumn("_gone", F.lit(True))
        return rows.join(gone, "ref_id", "left").select(*COLUMNS, F.coalesce("_gone", F.lit(False)).alias("deleted"))

    def rows(self) -> DataFrame:
        return self.all_rows().filter("NOT deleted").drop("deleted")

    # ---- changes

    def append(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> Gallery:
        """The next version, with rows (ref_id, label_id, z) numbered on by ref_id; an error, and no version, if one is unsound or its id is held already.

        ``stream``, the name of a stream and the number of its batch, is noted with the rows, so a batch is never appended twice.
        """
        done = self.manifest.get("streams", {})
        if stream and done.get(stream[0], -1) >= stream[1]:
            return self
        noted = {"streams": done | {stream[0]: stream[1]}} if stream else {}
        dim = self.manifest["passport"]["dim"]
        norm = F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        sound = F.col("ref_id").isNotNull() & F.col("label_id").isNotNull() & (F.size("z") == dim) & finite(F.col("z")) & (F.abs(F.sqrt(norm) - 1) <= NORM_TOL)
        fresh = cut(batch.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("label_id").cast("int").alias("label_id"), F.col("z").cast("array<float>").alias("z")))
        bad, n, ids = fresh.agg(F.count_if(~F.coalesce(sound, F.lit(False))), F.count("*"), F.count_distinct("ref_id")).collect()[0]
        if bad:
            raise ValueError(f"{bad} rows without id or label, of another dimension, not finite or not of unit length")
        held = fresh.join(self.all_rows().select("ref_id"), "ref_id", "left_semi").limit(1).count()
        if held or n != ids:
            raise ValueError("repeated ref_id")
        if not n:
            return self._next(**noted) if noted else self
        placed = numbered(fresh, ["ref_id"], "_no").withColumn("insert_no", F.col("_no") + F.lit(self.next_no)).select(*COLUMNS)
        return self._next(parts=[*self.manifest["parts"], self._write(placed)], **noted)

    def _write(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{name}")
        return {"name": name, **_summary(self.spark.read.schema(ROW).parquet(f"{self.path}/parts/{name}"))}

    def delete(self, ids: DataFrame) -> Gallery:
        """The next version, with the rows of ids (ref_id) marked as deleted; ids that are not held are an error."""
        wanted = cut(ids.select(F.col("ref_id").cast("long").alias("ref_id")).distinct())
        if wanted.join(self.rows().select("ref_id"), "ref_id", "left_anti").limit(1).count():
            raise ValueError("an id to delete is not held")
        if wanted.isEmpty():
            return self
        name = uuid.uuid4().hex
        wanted.write.parquet(f"{self.path}/deletes/{name}")
        return self._next(deletes=[*self.manifest["deletes"], {"name": name, **_summary(wanted)}])

    def compact(self) -> Gallery:
        """The next version, with deleted rows gone and all parts in one; insert numbers stay, so they may have gaps where rows went."""
        part = self._write(self.rows())
        gone = sum(p["rows"] for p in self.manifest["parts"]) - part["rows"]
        # the last number stays known even if its row went
        part |= {"first": 0, "last": self.next_no - 1, "gone": gone + sum(p.get("gone", 0) for p in self.manifest["parts"])}
        return self._next(parts=[part] if self.next_no else [], deletes=[])

    # ---- checks

    def verify(self) -> None:
        """Reads all parts once; an error names every part that is missing or changed, repeated ids, and gaps in the insert numbers."""
        wrong = []
        for kind, schema, entries in (("parts", ROW, self.manifest["parts"]), ("deletes", "ref_id long", self.manifest["deletes"])):
            for e in entries:
                uri = f"{self.path}/{kind}/{e['name']}"
                p, fs = _path(self.spark, f"{uri}/_SUCCESS")
                if not fs.exists(p):
                    wrong.append(f"{kind}/{e['name']} is missing or torn")
                    continue
                now = _summary(self.spark.read.schema(schema).parquet(uri))
                if (now["rows"], now["hash"]) != (e["rows"], e["hash"]):
                    wrong.append(f"{kind}/{e['name']} is not what was committed: {now['rows']} rows, {e['rows']} expected")
        expected = 0
        for e in self.manifest["parts"]:
            if e["first"] != expected or e["rows"] + e.get("gone", 0) != e["last"] - e["first"] + 1:
                wrong.append(f"insert numbers are not in sequence at parts/{e['name']}")
            expected = e["last"] + 1
        if not wrong:
            n, ids, numbers = self.all_rows().agg(F.count("*"), F.count_distinct("ref_id"), F.count_distinct("insert_no")).collect()[0]
            if n != ids or n != numbers:
                wrong.append("repeated ids or insert numbers")
        if wrong:
            raise ValueError(f"{self.path}, version {self.manifest['version']}: " + "; ".join(wrong))

    def vacuum(self) -> int:
        """Deletes manifests before this version and files that this version does not name; how many. For when nobody reads or writes."""
        n = 0
        named = {f"parts/{p['name']}" for p in self.manifest["parts"]} | {f"deletes/{d['name']}" for d in self.manifest["deletes"]}
        for kind in ("parts", "deletes", "manifest"):
            folder, fs = _path(self.spark, f"{self.path}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                name = s.getPath().getName()
                old = kind == "manifest" and name[:-5].isdigit() and int(name[:-5]) < self.manifest["version"]
                if old or kind != "manifest" and f"{kind}/{name}" not in named:
                    n += bool(fs.delete(s.getPath(), True))
        return n
