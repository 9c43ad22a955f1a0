"""Queries on descriptive statistics, verdict rules, data checks and scalar functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as X
from ..functions import text as T
from ..operators import rules as R
from ..operators import seam as SM
from ..operators import search as SE
from ..operators import stats as S
from ..session import table
from . import views as V
from .registry import query

EDGES = [0.0, 25.0, 50.0, 75.0, 100.0]
_HIST = ", ".join(f"count(*) FILTER (value>={lo} AND value{'<=' if i == 3 else '<'}{hi}) AS bin{i}" for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False)))


@query("dist_by_group", f"SELECT event_type, count(*) AS n, round(avg(value),6) AS mean, min(value) AS lo, max(value) AS hi, round(quantile_cont(value,0.05),6) AS q05, round(quantile_cont(value,0.25),6) AS q25, round(quantile_cont(value,0.5),6) AS q50, round(quantile_cont(value,0.75),6) AS q75, round(quantile_cont(value,0.95),6) AS q95, {_HIST} FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1")
def dist_by_group(spark, sf):
    return S.distribution(table(spark, sf, "events"), "value", ["event_type"], EDGES)


_RK = lambda c, o: f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c})-1)/2.0 AS {o}"


@query("spearman", f"WITH r AS (SELECT l_returnflag, {_RK('l_quantity', 'a')}, {_RK('l_discount', 'b')} FROM lineitem) SELECT l_returnflag, round(corr(a,b),6) AS rho, count(*) AS n FROM r GROUP BY 1")
def spearman(spark, sf):
    return S.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])


@query("ks_distance", "WITH g AS (SELECT event_type, value, count(*) FILTER (user_id%2=0) AS a, count(*) FILTER (user_id%2<>0) AS b FROM events GROUP BY ALL), c AS (SELECT event_type, abs(sum(a) OVER w/sum(a) OVER p - sum(b) OVER w/sum(b) OVER p) AS d FROM g WINDOW w AS (PARTITION BY event_type ORDER BY value), p AS (PARTITION BY event_type)) SELECT event_type, round(max(d),9) AS ks FROM c GROUP BY 1")
def ks_distance(spark, sf):
    return S.ks(table(spark, sf, "events"), "value", F.col("user_id") % 2 == 0, ["event_type"])


@query("wilson_interval", "WITH c AS (SELECT l_shipdate::DATE AS d, count(*)::DOUBLE AS n, (count(*) FILTER (l_returnflag='R'))/count(*) AS p FROM lineitem GROUP BY 1) SELECT d, round(((p+1.9208/n)-1.96*sqrt(p*(1-p)/n+0.9604/(n*n)))/(1+3.8416/n),6) AS lo, round(((p+1.9208/n)+1.96*sqrt(p*(1-p)/n+0.9604/(n*n)))/(1+3.8416/n),6) AS hi FROM c")
def wilson_interval(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return c.select("d", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("tie_ranks", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id)-1)/2.0::DOUBLE AS r FROM events")
def tie_ranks(spark, sf):
    from ..operators.metrics import average_ranks

    return average_ranks(table(spark, sf, "events"), "user_id", "r", ["event_type"]).select("event_id", "r")


@query("empirical_cdf", "SELECT DISTINCT p_size, count(*) OVER (ORDER BY p_size)/(SELECT count(*) FROM part) AS cdf FROM part")
def empirical_cdf(spark, sf):
    g = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("c"))
    return g.select("p_size", (F.sum("c").over(Window.orderBy("p_size")) / F.sum("c").over(Window.partitionBy())).alias("cdf"))


@query("median_minmax", "SELECT c_mktsegment, median(c_acctbal) AS med, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) FILTER (c_acctbal IS NULL) AS missing FROM customer GROUP BY 1")
def median_minmax(spark, sf):
    a = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.median(a).alias("med"), F.min(a).alias("lo"), F.max(a).alias("hi"), F.count_if(a.isNull()).alias("missing"))


@query("categories_by_subset", f"WITH {V.PRED}, {V.GT}, c AS (SELECT DISTINCT scene_id%4=0 AS cal, gt_label FROM gt) SELECT (SELECT count(DISTINCT gt_label) FROM c) AS n_all, (SELECT count(*) FROM c WHERE cal) AS cal, (SELECT count(*) FROM (SELECT gt_label FROM c WHERE NOT cal EXCEPT SELECT gt_label FROM c WHERE cal)) AS only_test")
def categories_by_subset(spark, sf):
    c = V.gt(spark, sf).select((F.col("scene_id") % 4 == 0).alias("cal"), "gt_label").distinct()
    cal, test = c.filter("cal").select("gt_label"), c.filter("NOT cal").select("gt_label")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(cal.union(test).distinct(), "n_all").crossJoin(n(cal, "cal")).crossJoin(n(test.subtract(cal), "only_test"))


@query("dup_content", "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*)>1")
def dup_content(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("grid_artifacts", f"WITH {V.PRED} SELECT scene_id, mask_no FROM (SELECT scene_id, mask_no, count(*) OVER (PARTITION BY scene_id%5, floor(x0/20), floor(y0/20)) AS c FROM pred) WHERE c=1")
def grid_artifacts(spark, sf):
    p = V.pred(spark, sf).select("scene_id", "mask_no", (F.col("scene_id") % 5).alias("board"), F.floor(F.col("x0") / 20).alias("cx"), F.floor(F.col("y0") / 20).alias("cy"))
    once = p.groupBy("board", "cx", "cy").agg(F.count("*").alias("c"), F.min(F.struct("scene_id", "mask_no")).alias("k")).filter("c = 1")
    return once.select("k.scene_id", "k.mask_no")


@query("board_pivot", f"WITH {V.PRED}, {V.GT} SELECT scene_id%5 AS board, {', '.join(f'count(*) FILTER (gt_label={i}) AS c{i}' for i in range(10))} FROM gt GROUP BY 1")
def board_pivot(spark, sf):
    """Boxes of each board by label, a column for each of the ten labels."""
    p = V.gt(spark, sf).groupBy((F.col("scene_id") % 5).alias("board")).pivot("gt_label", list(range(10))).agg(F.count("gt_no"))
    return p.select("board", *(F.coalesce(str(i), F.lit(0)).alias(f"c{i}") for i in range(10)))


@query("missing_pairs", "SELECT count(*) FILTER (o.o_orderkey IS NULL) AS no_order, count(*) FILTER (l.k IS NULL) AS no_line FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) l FULL JOIN orders o ON o.o_orderkey=l.k")
def missing_pairs(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    j = l.join(table(spark, sf, "orders").select("o_orderkey"), F.col("k") == F.col("o_orderkey"), "full_outer")
    return j.agg(F.count_if(F.col("o_orderkey").isNull()).alias("no_order"), F.count_if(F.col("k").isNull()).alias("no_line"))


@query("out_of_frame", f"WITH {V.PRED} SELECT count(*) FILTER (x1>640 OR y1>480) AS outside, count(*) AS n FROM pred")
def out_of_frame(spark, sf):
    return V.pred(spark, sf).agg(F.count_if((F.col("x1") > 640) | (F.col("y1") > 480)).alias("outside"), F.count("*").alias("n"))


@query("worst_five", f"WITH {V.PRED} SELECT scene_id, mask_no, score FROM pred ORDER BY score, scene_id, mask_no LIMIT 5")
def worst_five(spark, sf):
    return V.pred(spark, sf).select("scene_id", "mask_no", "score").orderBy("score", "scene_id", "mask_no").limit(5)


@query("mask_ids", f"WITH {V.PRED} SELECT scene_id||'#'||mask_no AS id, scene_id::VARCHAR AS scene, mask_no AS no FROM pred")
def mask_ids(spark, sf):
    p = V.pred(spark, sf).select(X.mask_id(F.col("scene_id"), F.col("mask_no")).alias("id")).withColumn("p", X.parse_mask_id(F.col("id")))
    return p.select("id", "p.scene", "p.no")


@query("flat_paths", "SELECT page_id, replace(url,'/','__') AS path FROM pages")
def flat_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.flat_path(F.col("url")).alias("path"))


@query("percent_format", "SELECT event_id, replace(printf('%.2f', event_id/8.0*100),'.',',') AS p FROM events")
def percent_format(spark, sf):
    return table(spark, sf, "events").select("event_id", X.percent(F.col("event_id") / 8.0).alias("p"))


@query("normalised", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings) SELECT vec_id, i::INT AS i, round(z[i]/sqrt(list_dot_product(z,z)),6) AS v FROM e, (SELECT unnest(range(1,(SELECT max(len(embedding)) FROM embeddings)+1)) AS i)")
def normalised(spark, sf):
    """All components of all vectors at unit length."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(X.normalise(F.col("embedding"))).alias("p", "v"))
    return e.select("vec_id", (F.col("p") + 1).alias("i"), F.round("v", 6).alias("v"))


@query("center_patches", f"WITH {V.PRED} SELECT scene_id, mask_no, (greatest(0,least(36,floor((y0+y1)/2/14)))*37+greatest(0,least(36,floor((x0+x1)/2/14))))::BIGINT AS patch FROM pred")
def center_patches(spark, sf):
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return V.pred(spark, sf).select("scene_id", "mask_no", X.center_patch(x, y, 14, 37).cast("long").alias("patch"))


@query("rle_areas", f"WITH {V.PRED} SELECT scene_id, mask_no, ((x1-x0)*(y1-y0))::BIGINT AS area, true AS same FROM pred")
def rle_areas(spark, sf):
    """Box masks, each in a frame of the box and one pixel around it, through run-length text and back: area, and whether decoding restores the mask."""
    return V.pred(spark, sf).select("scene_id", "mask_no", "x0", "y0", "x1", "y1").mapInArrow(rle_boxes(), "scene_id long, mask_no long, area long, same boolean")


SIZES_HELD = 1 << 16  # sizes of frames that a task remembers


def rle_boxes(encode=X.rle_encode):
    """The kernel of rle_areas. A frame depends on the size of its box alone, so each size is encoded and decoded once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(SIZES_HELD)
        def both(h: int, w: int) -> tuple[int, bool]:
            m = np.zeros((h + 2, w + 2), dtype=bool)
            m[1:-1, 1:-1] = True
            r = encode(m)
            return X.rle_area(r), bool((X.rle_decode(r) == m).all())

        for b in batches:
            x0, y0, x1, y1 = (c.to_numpy() for c in b.columns[2:])
            size, at = np.unique(((y1 - y0).astype(np.int64) << 32) | (x1 - x0).astype(np.int64), return_inverse=True)
            found = [both(k >> 32, k & 0xFFFFFFFF) for k in size.tolist()]
            area, same = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(area[at]), pa.array(same[at])], ["scene_id", "mask_no", "area", "same"])

    return run


@query("pool_features", "WITH e AS (SELECT label, i, round(sum(embedding[i]::DOUBLE*(vec_id%7))/sum(vec_id%7),6) AS v FROM embeddings, (SELECT unnest(range(1,(SELECT max(len(embedding)) FROM embeddings)+1)) AS i) GROUP BY ALL) SELECT label, i::INT AS i, v FROM e")
def pool_features(spark, sf):
    """The weighted mean of each component by label, all components, without unit length."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("p", "v"))
    w = F.col("vec_id") % 7
    return e.groupBy("label", (F.col("p") + 1).alias("i")).agg(F.round(F.sum(F.col("v").cast("double") * w) / F.sum(w), 6).alias("v"))


@query("pool_vectors", """WITH r AS (SELECT label, vec_id, vec_id%7 AS w, embedding AS z FROM embeddings), t AS (SELECT label, sum(w) AS total, min(vec_id)+max(vec_id) AS mid FROM r GROUP BY 1),
n AS (SELECT r.*, total, row_number() OVER (PARTITION BY r.label ORDER BY abs(2*vec_id-mid), vec_id) AS near FROM r JOIN t USING (label)), u AS (SELECT label, z, CASE WHEN total=0 THEN (near=1)::INT ELSE w END AS w FROM n),
e AS (SELECT label, i, sum(z[i]::DOUBLE*w)/sum(w) AS v FROM u, (SELECT unnest(range(1,(SELECT max(len(embedding)) FROM embeddings)+1)) AS i) GROUP BY ALL)
SELECT label, i::INT AS i, round(v/greatest(sqrt(sum(v*v) OVER (PARTITION BY label)),1e-12),6) AS v FROM e""")
def pool_vectors(spark, sf):
    """The pooled vector of each label at unit length, with the fallback for labels without weight."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", (F.col("vec_id") % 7).alias("w"), "embedding")
    return X.pool(e, "label", "vec_id", "w", "embedding").withColumn("v", F.round("v", 6))


@query("debias_project")
def debias_project(spark, sf):
    """Embeddings without the two leading directions of the encoder's answers to noise; returns what is left of the norm."""
    basis = SM.noise_directions(SM.StubEncoder(64), 2, (112, 112))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, z = SE._sound(b.column(1), 64)
            left = np.linalg.norm(X.project_out(z, basis), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.round(left, 6))], ["vec_id", "left"])

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, left double")


_F = "CASE WHEN {x} IS NULL THEN '—' ELSE {e} END"


@query("number_formats", "WITH v AS (SELECT event_id, event_id/8.0::DOUBLE-40 AS x, CASE WHEN event_id%5<>0 THEN event_id/16.0::DOUBLE END AS lo, CASE WHEN event_id%7<>0 THEN event_id/4.0::DOUBLE END AS hi FROM events), t AS (SELECT event_id, replace(printf('%.2f', x),'.',',') AS num, (CASE WHEN x<0 THEN '−' ELSE '+' END)||replace(printf('%.2f', abs(x)),'.',',') AS signed, CASE WHEN lo IS NULL OR hi IS NULL THEN '—' ELSE '['||replace(printf('%.2f', lo),'.',',')||'; '||replace(printf('%.2f', hi),'.',',')||']' END AS interval FROM v) SELECT t.*, CASE WHEN lo IS NULL THEN num ELSE num||' '||interval END AS both, event_id||'/8' AS frac FROM t JOIN v USING (event_id)")
def number_formats(spark, sf):
    """Numbers, signed numbers, intervals and both as text; a dash for what is missing."""
    i = F.col("event_id")
    v = table(spark, sf, "events").select("event_id", (i / 8.0 - 40).alias("x"), F.when(i % 5 != 0, i / 16.0).alias("lo"), F.when(i % 7 != 0, i / 4.0).alias("hi"))
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    return v.select("event_id", T.number(x).alias("num"), T.signed(x).alias("signed"), T.interval(lo, hi).alias("interval"), T.with_interval(x, lo, hi).alias("both"), T.fraction(i, F.lit(8)).alias("frac"))


@query("path_parts", r"SELECT page_id, regexp_extract(url, '^(.*)/', 1) AS before, string_split(url,'/')[-1] AS after FROM pages")
def path_parts(spark, sf):
    """A path before and after its last slash."""
    from ..sources.files import rsplit

    p = rsplit(F.col("url"), "/")
    return table(spark, sf, "pages").select("page_id", p["before"].alias("before"), p["after"].alias("after"))
