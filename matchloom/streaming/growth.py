"""Gallery growth as a stream: each batch of rows is appended, counted and checked.

Defined results: deleted rows do not count; a batch that is repeated after a restart counts once; an empty
folder gives no batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "ref_id long, label_id int, insert_no long, deleted boolean, z array<float>"


def running(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of gallery rows in ``folder`` to live rows and the highest insert_no by label."""
    s = spark.readStream.schema(SCHEMA).parquet(folder)
    return s.filter("NOT deleted").groupBy("label_id").agg(F.count("*").alias("n"), F.max("insert_no").alias("last"))


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream of totals (a row for each label) over what is there and returns its complete result, written beside the checkpoint."""
    out = f"{checkpoint}-{name}"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(out)

    q = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def watch(stream: DataFrame, folder: str, n0: int, delta: float, check: Callable[[DataFrame], tuple[int, int]] | None = None, limit: float | None = None) -> DataFrame:
    """Counts live rows batch by batch; (batch, added, n, recalibrate, k, m, exceeded) of all batches so far.

    A batch asks for recalibration where n / n0 > 1 + delta, or where ``check``, given the batch, answers with
    k of m control rows above the threshold and k / m > limit. State is what is in ``folder``: the stream's checkpoint and
    a row for each batch, written under its number, so a restart goes on where it stopped and a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    schema = "batch long, added long, k long, m long"

    def run(df: DataFrame, batch: int) -> None:
        added = df.filter("NOT deleted").count()
        k, m = check(df) if check is not None else (None, None)
        spark.createDataFrame([(batch, added, k, m)], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/number={batch}")

    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(run).start()
    q.awaitTermination()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "batch long, added long, n long, recalibrate boolean, k long, m long, exceeded boolean")
    rows = spark.read.schema(schema).parquet(f"{folder}/batches")  # a row for each batch
    n = F.lit(n0) + F.sum("added").over(Window.orderBy("batch"))
    over = F.col("k") / F.col("m") > limit if limit is not None else F.lit(None).cast("boolean")
    return rows.select("batch", "added", n.alias("n"), (n / n0 > 1 + delta).alias("recalibrate"), "k", "m", over.alias("exceeded"))


def batches(gallery: DataFrame, size: int) -> DataFrame:
    """The same rows as batch arithmetic: rows so far after each block of insert numbers. A row for each block in one task."""
    b = gallery.groupBy(F.expr(f"insert_no div {size}").alias("batch")).agg(F.count("*").alias("added"))
    return b.withColumn("n", F.sum("added").over(Window.orderBy("batch")))
