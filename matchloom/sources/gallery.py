"""The gallery as a table: validated appends, snapshots, row protocols, integrity, row-set hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.numbering import numbered

REQUIRED = ("ref_id", "label_id", "insert_no", "deleted", "z")


def finite(z: Column) -> Column:
    return F.forall(z, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def label_ids(rows: DataFrame, label: str = "label") -> DataFrame:
    """Positions of the sorted distinct labels over all rows, deleted ones too."""
    return rows.select(label).distinct().withColumn("id", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))


def append(gallery: DataFrame, batch: DataFrame, dim: int) -> DataFrame:
    """gallery and batch, numbered on; fails on repeated ids, wrong dimensions, non-finite values or null labels."""
    last = gallery.agg(F.coalesce(F.max("insert_no"), F.lit(-1)).alias("last"))
    ids = numbered(batch.select("ref_id").distinct(), ["ref_id"], "_no")
    ok = (F.size("z") == dim) & finite(F.col("z")) & F.col("label_id").isNotNull() & F.col("ref_id").isNotNull()
    fresh = batch.join(ids, "ref_id", "left").crossJoin(F.broadcast(last)).withColumn("insert_no", (F.col("_no") + 1 + F.col("last")).cast("long")).withColumn("deleted", F.lit(False))
    fresh = fresh.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("invalid gallery row")).isNull())
    out = gallery.select(*REQUIRED).unionByName(fresh.select(*REQUIRED))
    n = F.count("*").over(Window.partitionBy("ref_id"))
    return out.withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, F.lit("repeated ref_id")).isNull()).drop("_n")


def rows(gallery: DataFrame, protocol: str = "full", upto: int | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Rows of a protocol: full, one_per_class (the smallest id of a label), or dedup (a kept list), as of insert_no."""
    out = gallery.filter("NOT deleted")
    if upto is not None:
        out = out.filter(F.col("insert_no") <= upto)
    if protocol == "one_per_class":
        w = Window.partitionBy("label_id").orderBy("ref_id")
        out = out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    elif protocol == "dedup":
        out = out.join(kept.select("insert_no"), "insert_no", "left_semi")
    elif protocol != "full":
        raise ValueError(protocol)
    return out


def rows_sha256(rows_: DataFrame) -> str:
    """sha256 of the ids in insert order, joined by line feeds. One running digest: ids stream through the driver, a partition at a time."""
    digest, first = hashlib.sha256(), True
    for r in rows_.select("insert_no", F.col("ref_id").cast("string").alias("id")).orderBy("insert_no", "id").toLocalIterator(prefetchPartitions=True):
        digest.update((r["id"] if first else "\n" + r["id"]).encode())
        first = False
    return digest.hexdigest()


def blocks_sha256(rows_: DataFrame) -> DataFrame:
    """One hash over hashes of blocks of 65,536 insert numbers: no task and no driver sees all ids. Not equal to rows_sha256."""
    block = rows_.select(F.expr("insert_no div 65536").alias("blk"), "insert_no", F.col("ref_id").cast("string").alias("id"))
    parts = block.groupBy("blk").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("insert_no", "id"))), lambda x: x["id"]), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "h"))), lambda x: x["h"]), "\n"), 256).alias("blocks_sha256"))


def problems(gallery: DataFrame) -> DataFrame:
    """Counts of violated invariants: all zero for a sound gallery."""
    return gallery.agg(
        (F.count("*") - F.count_distinct("ref_id")).alias("repeated_ids"),
        F.count_if(~finite(F.col("z"))).alias("not_finite"),
        (F.count_distinct(F.size("z")) - 1).alias("extra_dims"),
        F.count_if(F.col("label_id").isNull()).alias("no_label"),
    )


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows either side has that the other lacks."""
    x, y = a.exceptAll(b).agg(F.count("*").alias("only_a")), b.exceptAll(a).agg(F.count("*").alias("only_b"))
    return x.crossJoin(y)
