"""Tables written to the shared folder of spark.checkpoint.dir, to cut lineage.

A stashed table is plain Parquet, readable by every executor, so a lost executor
costs only the tasks it ran.  Executor-local storage is never used.

Stashed tables belong to the application: steps drop those that no later step
reads, ``close`` drops all, and what is left is deleted when the application ends.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of the queries: whole texts travel in them, and both sides hold one per task.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: Shuffle files go once the table they were for is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, set[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Smaller Arrow batches in this session, unless it has sizes of its own."""
    usual = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": None}
    for k, v in ARROW.items():
        now = spark.conf.get(k, None)
        if now is None or now == usual[k] or k.endswith("BytesPerBatch") and not now.isdigit() or k.endswith("BytesPerBatch") and int(now) > 16 << 20:
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own, but only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/matchloom-{os.getuid()}"
    return folder.rstrip("/")


def _path(spark: SparkSession, uri: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the application."""
    uri = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, uri)
    fs.mkdirs(p.getParent())
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # takes only paths that are there
    _made.setdefault(spark.sparkContext.applicationId, set()).add(uri)
    return uri


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns it as read back."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _delete(spark: SparkSession, uri: str) -> None:
    p, fs = _path(spark, uri)
    fs.delete(p, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(uri)


def drop(*stashed: DataFrame) -> None:
    """Deletes stashed tables that no later step reads."""
    for df in stashed:
        if path := getattr(df, "_stash_path", None):
            _delete(df.sparkSession, path)


def made(spark: SparkSession) -> frozenset[str]:
    """The tables and folders that are there now, for ``drop_since``."""
    return frozenset(_made.get(spark.sparkContext.applicationId, ()))


def drop_since(spark: SparkSession, before: frozenset[str], *keep: DataFrame) -> None:
    """Deletes what has been made since ``before``, but for the tables ``keep``."""
    for uri in made(spark) - before - {df._stash_path for df in keep}:
        _delete(spark, uri)


def close(spark: SparkSession) -> None:
    """Deletes all stashed tables and model files of this application: for when their results have been written."""
    for uri in list(_made.get(spark.sparkContext.applicationId, ())):
        _delete(spark, uri)


def local_path(uri: str) -> str:
    """The path by which Python workers open a file of the shared folder (a mounted file system)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"the shared folder must be mounted on the workers, not {uri}")
    return uri
