"""The shared folder, and cutting lineage in loops by reliable checkpoints in it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go once the table they were for is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, but only on a local master: executors of a cluster would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/matchloom-{os.getuid()}"
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    uri = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return uri


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: for many rows, which a checkpoint would hold uncompressed."""
    spark = df.sparkSession
    uri, before = fresh_folder(spark, "stored"), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    return spark.read.schema(df.schema).parquet(uri)
