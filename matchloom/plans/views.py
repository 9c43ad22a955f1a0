"""Input views: scenes of candidate boxes, ground truth, gallery, queries, chains and bootstrap weights.

Each view is a DataFrame over the raw tables and, for oracles, a SQL text of the same meaning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.kernel import per_group
from ..session import table
from .numbering import numbered

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate masks: scene_id, mask_no, box (exclusive pixels), label_id, score."""
    w = Window.partitionBy("scene_id").orderBy(*_ORDER)
    return (
        table(spark, sf, "lineitem")
        .withColumn("scene_id", F.expr("CAST(floor(l_orderkey/30) AS BIGINT)"))
        .withColumn("mask_no", (F.row_number().over(w) - 1).cast("long"))
        .selectExpr(
            "scene_id", "mask_no",
            "CAST((l_partkey*37)%600 AS DOUBLE) x0", "CAST((l_suppkey*53+l_orderkey*17)%450 AS DOUBLE) y0",
            "CAST((l_partkey*37)%600+20+l_partkey%60 AS DOUBLE) x1",
            "CAST((l_suppkey*53+l_orderkey*17)%450+20+CAST(l_quantity AS BIGINT) AS DOUBLE) y1",
            "CAST(l_suppkey%10 AS INT) label_id",
            "CAST((l_partkey*7919+l_suppkey*104729+l_orderkey*31)%1009 AS DOUBLE)/1009.0D score",
        )
    )


def gt(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth: every sixth mask, jittered."""
    w = Window.partitionBy("scene_id").orderBy("mask_no")
    return pred(spark, sf).filter("mask_no % 6 = 0").select(
        "scene_id", (F.row_number().over(w) - 1).cast("long").alias("gt_no"), F.col("label_id").alias("gt_label"),
        (F.col("x0") + F.col("mask_no") % 5).alias("x0"), (F.col("y0") + F.col("mask_no") % 7).alias("y0"),
        (F.col("x1") + F.col("mask_no") % 3).alias("x1"), (F.col("y1") + F.col("mask_no") % 11).alias("y1"),
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """Ignore zones: one box for every fourth scene."""
    return pred(spark, sf).filter("scene_id % 4 = 0 AND mask_no = 1").select("scene_id", "x0", "y0", (F.col("x1") + 40).alias("x1"), (F.col("y1") + 40).alias("y1"))


def ref(spark: SparkSession, sf: str, with_deleted: bool = False) -> DataFrame:
    """Gallery rows: ref_id, label_id, insert_no, deleted, z."""
    r = table(spark, sf, "embeddings").filter("vec_id % 2 = 1").selectExpr("vec_id ref_id", "label label_id", "vec_id insert_no", "vec_id % 50 = 49 deleted", "embedding z")
    return r if with_deleted else r.filter("NOT deleted")


def query(spark: SparkSession, sf: str) -> DataFrame:
    """Query rows: scene_id, mask_no, vec_id, known, z."""
    return table(spark, sf, "embeddings").filter("vec_id % 2 = 0").selectExpr("vec_id div 20 scene_id", "vec_id % 20 mask_no", "vec_id", "label label_id", "vec_id % 4 = 0 known", "embedding z")


def chain(spark: SparkSession, sf: str, n: int = 9) -> DataFrame:
    """Permutation chains of the labels: r, pos, label_id."""
    labels = table(spark, sf, "embeddings").select(F.col("label").alias("label_id")).distinct()
    w = Window.partitionBy("r").orderBy(F.md5(F.concat_ws(":", F.col("r").cast("string"), F.col("label_id").cast("string"))))
    return labels.crossJoin(spark.range(n).withColumnRenamed("id", "r")).select("r", (F.row_number().over(w) - 1).cast("long").alias("pos"), "label_id")


DRAWS_AT_ONCE, SLICE = 1 << 18, 4096


def _drawn(b: int, n: int) -> np.ndarray:
    """How often each of n scenes is drawn in replicate b: draw j takes the first 32 bits of the MD5 of "b:j", modulo n."""
    w = np.zeros(n, np.int64)
    for lo in range(0, n, DRAWS_AT_ONCE):
        some = range(lo, min(lo + DRAWS_AT_ONCE, n))
        first = b"".join(hashlib.md5(b"%d:%d" % (b, j)).digest()[:4] for j in some)
        w += np.bincount(np.frombuffer(first, ">u4").astype(np.int64) % n, minlength=n)
    return w


def _draws(scenes: DataFrame, replicates: int, out: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], names: str) -> tuple[DataFrame, DataFrame]:
    """The numbered scenes (scene_id, i), and what ``out`` makes of the weights of each replicate: a replicate is drawn in one task, with a number for each scene."""
    s = numbered(scenes.select("scene_id").distinct(), ["scene_id"], "i")
    n = s.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in x.column(0).to_pylist():
                yield from out(b, _drawn(b, n))

    return s, s.sparkSession.range(0, replicates, 1, min(replicates, 256)).mapInArrow(run, names)


def boot(scenes: DataFrame, replicates: int = 50) -> DataFrame:
    """Multinomial scene weights (b, scene_id, w) by hashes: n draws of n scenes for each replicate.

    The scenes are numbered in order; a weight table has replicates x scenes rows at most.
    """

    def rows(b: int, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(w), DRAWS_AT_ONCE):
            i = np.flatnonzero(w[lo : lo + DRAWS_AT_ONCE]) + lo
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), b)), pa.array(i), pa.array(w[i])], ["b", "i", "w"])

    s, drawn = _draws(scenes, replicates, rows, "b long, i long, w long")
    return drawn.join(s.hint("merge"), "i").select("b", "scene_id", "w")


def boot_vectors(scenes: DataFrame, replicates: int) -> DataFrame:
    """The weights of ``boot`` as (scene_id, wv): all replicates of a scene in one vector of 8 or 16 bits each."""

    def slices(b: int, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = w.astype("<u2")  # n draws of n scenes: none is drawn 65,536 times
        lo = np.arange(0, len(w), SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(lo // SLICE), pa.array(np.full(len(lo), b)), pa.array([v[k : k + SLICE].tobytes() for k in lo.tolist()], pa.binary())], ["slice", "b", "v"])

    def turned(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = np.frombuffer(b"".join(x["v"][np.argsort(x["b"])]), "<u2").reshape(replicates, -1).T
        v = np.ascontiguousarray(v.astype("<u1") if v.max() < 256 else v)
        held = np.empty(len(v), object)
        held[:] = [r.tobytes() for r in v]
        return {"i": x["slice"][0] * SLICE + np.arange(len(v)), "wv": held}

    s, drawn = _draws(scenes, replicates, slices, "slice long, b long, v binary")
    return per_group(drawn, "slice", turned, "i long, wv binary").join(s.hint("merge"), "i").select("scene_id", "wv")


# ---- the same views for oracles ------------------------------------------------

PRED = f"""pred AS (SELECT CAST(floor(l_orderkey/30) AS BIGINT) AS scene_id,
 row_number() OVER (PARTITION BY CAST(floor(l_orderkey/30) AS BIGINT) ORDER BY {",".join(_ORDER)})-1 AS mask_no,
 CAST((l_partkey*37)%600 AS DOUBLE) AS x0, CAST((l_suppkey*53+l_orderkey*17)%450 AS DOUBLE) AS y0,
 CAST((l_partkey*37)%600+20+l_partkey%60 AS DOUBLE) AS x1, CAST((l_suppkey*53+l_orderkey*17)%450+20+CAST(l_quantity AS BIGINT) AS DOUBLE) AS y1,
 CAST(l_suppkey%10 AS INT) AS label_id, CAST((l_partkey*7919+l_suppkey*104729+l_orderkey*31)%1009 AS DOUBLE)/1009.0 AS score
 FROM lineitem)"""
GT = """gt AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY mask_no)-1 AS gt_no, label_id AS gt_label,
 x0+(mask_no%5) AS x0, y0+(mask_no%7) AS y0, x1+(mask_no%3) AS x1, y1+(mask_no%11) AS y1 FROM pred WHERE mask_no%6=0)"""
ZONES = "zones AS (SELECT scene_id, x0, y0, x1+40 AS x1, y1+40 AS y1 FROM pred WHERE scene_id%4=0 AND mask_no=1)"
REF = "ref AS (SELECT vec_id AS ref_id, label AS label_id, vec_id AS insert_no, embedding::DOUBLE[] AS z FROM embeddings WHERE vec_id%2=1 AND vec_id%50<>49)"
QUERY = "query AS (SELECT vec_id//20 AS scene_id, vec_id%20 AS mask_no, vec_id, label AS label_id, vec_id%4=0 AS known, embedding::DOUBLE[] AS z FROM embeddings WHERE vec_id%2=0)"
SIM = "sim AS (SELECT q.scene_id, q.mask_no, q.vec_id, q.known, r.ref_id, r.label_id, r.insert_no, list_dot_product(q.z, r.z) AS s FROM query q, ref r)"
CHAIN = """chain AS (SELECT r.r::BIGINT AS r, row_number() OVER (PARTITION BY r.r ORDER BY md5(concat(r.r, ':', l.label)))-1 AS pos, l.label AS label_id
 FROM (SELECT DISTINCT label FROM embeddings) l, (SELECT unnest(range(9)) AS r) r)"""


def boot_sql(scenes: str, replicates: int = 50) -> str:
    return f"""sc AS (SELECT scene_id, row_number() OVER (ORDER BY scene_id)-1 AS i FROM (SELECT DISTINCT scene_id FROM {scenes})),
boot AS (SELECT b, scene_id, w FROM (SELECT b, ('0x'||substr(md5(concat(b,':',j)),1,8))::BIGINT % (SELECT count(*) FROM sc) AS i, count(*) AS w
 FROM (SELECT unnest(range({replicates})) AS b), (SELECT i AS j FROM sc) GROUP BY ALL) JOIN sc USING (i))"""
