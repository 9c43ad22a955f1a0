"""Queries of reports: composites over scenes and gallery, the remaining verdict rules, formats and record sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import greedy as G
from ..operators import metrics as M
from ..operators import nesting as N
from ..operators import ranks as RK
from ..operators import rules as R
from ..operators import stats as S
from ..session import table
from ..sources import voc
from . import catalog_gallery as CG
from . import catalog_scenes as CS
from . import views as V
from .cut import cut, fresh_folder
from .registry import query

SUBSET = "CASE WHEN scene_id%4=0 THEN 'cal' ELSE 'test' END"


def _area():
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def _hits(spark, sf):
    """Assigned masks of ground-truth boxes with hit: the mask's label is the box's."""
    g, m = V.gt(spark, sf), V.pred(spark, sf)
    o = G.oracle_assign(g, m).filter("mask_no >= 0").join(g.select("scene_id", "gt_no", "gt_label"), ["scene_id", "gt_no"])
    return o.join(m.select("scene_id", "mask_no", "label_id"), ["scene_id", "mask_no"]).withColumn("hit", F.col("label_id") == F.col("gt_label"))


HITS = "hits AS (SELECT o.scene_id, o.mask_no, o.gt_label, m.label_id=o.gt_label AS hit FROM oracle o JOIN pred m ON m.scene_id=o.scene_id AND m.mask_no=o.mask_no)"


@query("top1_by_subset", f"WITH RECURSIVE {CS.ORACLE}, {HITS}, x AS (SELECT {SUBSET} AS split, (scene_id%3)::VARCHAR AS level, hit FROM hits) SELECT coalesce(split,'all') AS split, coalesce(level,'all') AS level, count(*) AS n, count(*) FILTER (hit) AS hit FROM x GROUP BY CUBE(split, level)")
def top1_by_subset(spark, sf):
    x = _hits(spark, sf).select(F.when(F.col("scene_id") % 4 == 0, "cal").otherwise("test").alias("split"), (F.col("scene_id") % 3).cast("string").alias("level"), "hit")
    c = x.cube("split", "level").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit"))
    return c.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("level", F.lit("all")).alias("level"), "n", "hit")


@query("top1_by_label", f"WITH RECURSIVE {CS.ORACLE}, {HITS} SELECT gt_label, count(*) AS n, count(*) FILTER (hit) AS hit FROM hits GROUP BY 1")
def top1_by_label(spark, sf):
    return _hits(spark, sf).groupBy("gt_label").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit"))


@query("objects_with_parent", f"WITH RECURSIVE {CS.ORACLE}, {CS.NEST}, {CS.PARENT}, {HITS}, r AS (SELECT p.parent IS NOT NULL AS up, ((m.x1-m.x0)*(m.y1-m.y0))/((q.x1-q.x0)*(q.y1-q.y0)) AS ratio FROM hits h JOIN pred m USING (scene_id, mask_no) LEFT JOIN par p USING (scene_id, mask_no) LEFT JOIN pred q ON q.scene_id=h.scene_id AND q.mask_no=p.parent) SELECT count(*) AS n, count(*) FILTER (up) AS with_parent, round(quantile_cont(ratio,0.5),6) AS q50, round(quantile_cont(ratio,0.95),6) AS q95 FROM r")
def objects_with_parent(spark, sf):
    m = V.pred(spark, sf)
    a = m.select("scene_id", "mask_no", _area().alias("area"))
    up = N.parents(N.nested(m)).join(a.toDF("scene_id", "parent", "host"), ["scene_id", "parent"])
    r = _hits(spark, sf).select("scene_id", "mask_no").join(a, ["scene_id", "mask_no"]).join(up, ["scene_id", "mask_no"], "left").withColumn("ratio", F.col("area") / F.col("host"))
    r = cut(r)
    q = RK.quantiles_by(r, "ratio", [], {"q50": 0.5, "q95": 0.95}).select(F.round("q50", 6).alias("q50"), F.round("q95", 6).alias("q95"))
    return r.agg(F.count("*").alias("n"), F.count("parent").alias("with_parent")).crossJoin(F.broadcast(q))  # a row each


_RULES = {"all": "SELECT scene_id, mask_no FROM pred", "maximal": "SELECT scene_id, mask_no FROM pred m WHERE NOT EXISTS (SELECT 1 FROM nest n WHERE n.scene_id=m.scene_id AND n.a=m.mask_no)", "minimal": "SELECT scene_id, mask_no FROM pred m WHERE NOT EXISTS (SELECT 1 FROM nest n WHERE n.scene_id=m.scene_id AND n.b=m.mask_no)", "rho": "SELECT scene_id, mask_no FROM rho"}


@query("rule_metrics", f"WITH RECURSIVE {CS.RHO}, {V.GT}, {CS.PAIR}, k AS ({' UNION ALL '.join(f'SELECT *, {n!r} AS rule FROM ({q})' for n, q in _RULES.items())}), f AS (SELECT rule, count(*) AS found, count(*) FILTER (masks>=2) AS multiple FROM (SELECT rule, p.scene_id, p.gt_no, count(*) AS masks FROM k JOIN p ON p.scene_id=k.scene_id AND p.mask_no=k.mask_no WHERE p.iou>=0.5 GROUP BY ALL) GROUP BY rule) SELECT rule, kept, found, multiple FROM (SELECT rule, count(*) AS kept FROM k GROUP BY rule) JOIN f USING (rule)")
def rule_metrics(spark, sf):
    """What each selection rule keeps: masks, ground truth found at IoU 0.5, and found more than once."""
    g, m = V.gt(spark, sf), V.pred(spark, sf)
    e = N.nested(m)
    k = None
    for name, kept in (("all", m), ("maximal", N.maximal(m, e)), ("minimal", N.minimal(m, e)), ("rho", N.select(m))):
        part = kept.select("scene_id", "mask_no", F.lit(name).alias("rule"))
        k = part if k is None else k.unionByName(part)
    p = B.pairs(g, m, 0.5).select("scene_id", "gt_no", "mask_no")
    # one shuffle of the rules' rows serves both counts
    x = k.join(p, ["scene_id", "mask_no"], "left").groupBy("rule", "scene_id", "gt_no").agg(F.count_distinct("mask_no").alias("masks"))
    found = x.filter("gt_no IS NOT NULL").groupBy("rule").agg(F.count("*").alias("found"), F.count_if(F.col("masks") >= 2).alias("multiple"))
    return k.groupBy("rule").agg(F.count("*").alias("kept")).join(found, "rule")


@query("rule_recall_by_bin", f"WITH RECURSIVE {CS.RHO}, {V.GT}, {CS.PAIR}, k AS ({' UNION ALL '.join(f'SELECT *, {n!r} AS rule FROM ({q})' for n, q in _RULES.items())}), h AS (SELECT DISTINCT rule, p.scene_id, p.gt_no FROM k JOIN p ON p.scene_id=k.scene_id AND p.mask_no=k.mask_no WHERE p.iou>=0.5), g AS (SELECT scene_id, gt_no, (x1-x0)*(y1-y0) AS gt_area FROM gt), n AS (SELECT {CS.ABIN} AS abin, count(*) AS n FROM g GROUP BY 1), f AS (SELECT rule, {CS.ABIN} AS abin, count(*) AS found FROM h JOIN g USING (scene_id, gt_no) GROUP BY ALL) SELECT r.rule, n.abin, n.n, coalesce(f.found,0) AS found, coalesce((SELECT sum(x.found) FROM f x WHERE x.rule='all' AND x.abin=n.abin),0)::BIGINT-coalesce(f.found,0) AS lost FROM (SELECT DISTINCT rule FROM k) r CROSS JOIN n LEFT JOIN f ON f.rule=r.rule AND f.abin=n.abin")
def rule_recall_by_bin(spark, sf):
    """By selection rule and area: ground truth, what of it is found, and what is lost against all masks."""
    g, m = V.gt(spark, sf), V.pred(spark, sf)
    e = cut(N.nested(m))
    k = None
    for name, kept in (("all", m), ("maximal", N.maximal(m, e)), ("minimal", N.minimal(m, e)), ("rho", N.select(m))):
        part = kept.select("scene_id", "mask_no", F.lit(name).alias("rule"))
        k = part if k is None else k.unionByName(part)
    area = g.select("scene_id", "gt_no", B.area_bin(_area()).alias("abin"))
    hit = k.join(B.pairs(g, m, 0.5).select("scene_id", "gt_no", "mask_no"), ["scene_id", "mask_no"]).select("rule", "scene_id", "gt_no").distinct()
    found = cut(hit.join(area, ["scene_id", "gt_no"]).groupBy("rule", "abin").agg(F.count("*").alias("found")))  # a row for each rule and bin
    every = found.filter("rule = 'all'").select("abin", F.col("found").alias("every"))
    rules = spark.createDataFrame([(n,) for n in _RULES], "rule string")
    n = area.groupBy("abin").agg(F.count("*").alias("n")).crossJoin(F.broadcast(rules))
    x = n.join(found, ["rule", "abin"], "left").join(every, "abin", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("rule", "abin", "n", zero("found").alias("found"), (zero("every") - zero("found")).alias("lost"))


@query("nesting_by_ratio", f"WITH {CS.NESTED} SELECT (10*area_a//area_b) AS tenth, count(*) AS n, count(*) FILTER (5*area_a>=4*area_b) AS near, count(*) FILTER (v=area_a) AS inside FROM nest GROUP BY 1")
def nesting_by_ratio(spark, sf):
    e = N.nested(V.pred(spark, sf)).withColumn("tenth", F.expr("10 * area_a div area_b"))
    return e.groupBy("tenth").agg(F.count("*").alias("n"), F.count_if(F.expr("5 * area_a >= 4 * area_b")).alias("near"), F.count_if(F.expr("v = area_a")).alias("inside"))


@query("mask_stats", f"WITH {V.PRED}, a AS (SELECT scene_id, (x1-x0)*(y1-y0) AS gt_area FROM pred) SELECT scene_id, count(*) AS n, round(quantile_cont(gt_area,0.5),6) AS q50, round(quantile_cont(gt_area,0.9),6) AS q90, round(count(*) FILTER ({CS.ABIN}=0)/count(*),9) AS small FROM a GROUP BY 1")
def mask_stats(spark, sf):
    a = V.pred(spark, sf).select("scene_id", _area().alias("a"))
    q = lambda p: F.round(F.percentile("a", F.lit(p)), 6)
    return a.groupBy("scene_id").agg(F.count("*").alias("n"), q(0.5).alias("q50"), q(0.9).alias("q90"), F.round(F.count_if(B.area_bin(F.col("a")) == 0) / F.count("*"), 9).alias("small"))


_FITS = "round(avg(((x0+x1)/2-{f}*s/2>=0 AND (y0+y1)/2-{f}*s/2>=0 AND (x0+x1)/2+{f}*s/2<=720 AND (y0+y1)/2+{f}*s/2<=540)::INT),9)"


@query("ref_geometry", f"WITH {V.PRED}, r AS (SELECT *, greatest(x1-x0,y1-y0) AS s FROM pred) SELECT round(min(s)/720,6) AS lo, round(quantile_cont(s,0.5)/720,6) AS q50, round(max(s)/720,6) AS hi, {_FITS.format(f='1.0')} AS fits_10, {_FITS.format(f='1.5')} AS fits_15, count(*) FILTER (x0=0 OR y0=0 OR x1=720 OR y1=540) AS touching FROM r")
def ref_geometry(spark, sf):
    """Side of boxes against a frame of 720 x 540, and the share of squares that stay in it."""
    r = V.pred(spark, sf).withColumn("s", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    q = RK.quantiles_by(r, "s", [], {"q": 0.5}).collect()[0]["q"]
    fits = lambda f: F.round(F.avg(F.expr(f"(x0+x1)/2-{f}D*s/2>=0 AND (y0+y1)/2-{f}D*s/2>=0 AND (x0+x1)/2+{f}D*s/2<=720 AND (y0+y1)/2+{f}D*s/2<=540").cast("int")), 9)
    return r.agg(F.round(F.min("s") / 720, 6).alias("lo"), F.round(F.lit(q) / 720, 6).alias("q50"), F.round(F.max("s") / 720, 6).alias("hi"), fits("1.0").alias("fits_10"), fits("1.5").alias("fits_15"), F.count_if(F.expr("x0=0 OR y0=0 OR x1=720 OR y1=540")).alias("touching"))


@query("matched_sets", f"WITH {V.PRED}, g AS (SELECT * FROM pred WHERE mask_no%2=0), m AS (SELECT * FROM pred WHERE mask_no%2=1), x AS (SELECT g.scene_id, g.mask_no, max({CS.IOU}/((g.x1-g.x0)*(g.y1-g.y0)+(m.x1-m.x0)*(m.y1-m.y0)-{CS.IOU})) AS iou FROM g JOIN m ON g.scene_id=m.scene_id AND g.x0<m.x1 AND m.x0<g.x1 AND g.y0<m.y1 AND m.y0<g.y1 GROUP BY ALL) SELECT g.scene_id, g.mask_no, coalesce(x.iou,0) AS iou, coalesce(x.iou,0)>=0.5 AS matched FROM g LEFT JOIN x USING (scene_id, mask_no)")
def matched_sets(spark, sf):
    """Two sets of masks of a scene: the best IoU of each mask of the first, and whether it is matched."""
    p = V.pred(spark, sf)
    first = p.filter("mask_no % 2 = 0").withColumnsRenamed({"mask_no": "gt_no", "label_id": "gt_label"}).drop("score")
    best = B.best_per_gt(first, p.filter("mask_no % 2 = 1"))
    return best.select("scene_id", F.col("gt_no").alias("mask_no"), F.col("best_iou").alias("iou"), (F.col("best_iou") >= 0.5).alias("matched"))


@query("zones_json", f"WITH {V.PRED}, {V.ZONES} SELECT scene_id, x0, y0, x1, y1 FROM zones")
def zones_json(spark, sf):
    """Ignore zones as JSON text, scene to boxes, read back."""
    z = V.zones(spark, sf).groupBy("scene_id").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("b"))
    text = z.select(F.to_json(F.create_map(F.col("scene_id").cast("string"), F.col("b"))).alias("json"))
    back = text.select(F.explode(F.from_json("json", "map<string,array<array<double>>>")).alias("scene", "b")).select("scene", F.explode("b").alias("b"))
    return back.select(F.col("scene").cast("long").alias("scene_id"), *(F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("rename_drop", "SELECT CASE r_name WHEN 'ASIA' THEN 'AFRICA 2' ELSE r_name END AS name, row_number() OVER (ORDER BY CASE r_name WHEN 'ASIA' THEN 'AFRICA 2' ELSE r_name END)-1 AS category_id FROM region WHERE r_name<>'EUROPE'")
def rename_drop(spark, sf):
    """Names after a map of renames and a list of drops, with their place in the dictionary; an unknown name is an error."""
    names = table(spark, sf, "region").select(F.col("r_name").alias("name"))
    out = voc.with_rules(names, {"ASIA": "AFRICA 2"}, ["EUROPE"], ["AFRICA", "AFRICA 2", "AMERICA", "MIDDLE EAST"])
    return out.select("name", F.col("category_id").cast("long").alias("category_id"))


_ONE = CG.dec_sql("o").replace("dec AS", "one_dec AS", 1)


@query("labels_changed", f"WITH {CG.SIM}, {CG.BYLABEL}, {CG.dec_sql()}, one AS (SELECT label_id, min(ref_id) AS ref_id FROM ref GROUP BY 1), o AS (SELECT sim.* FROM sim JOIN one ON sim.ref_id=one.ref_id), {_ONE}, t AS (SELECT * FROM dec ORDER BY s_star DESC, vec_id LIMIT 100) SELECT count(*) AS n, count(*) FILTER (t.y_hat<>d.y_hat) AS changed FROM t JOIN one_dec d USING (vec_id)")
def labels_changed(spark, sf):
    """Among the 100 surest answers, those that another gallery protocol labels differently."""
    top = CG._decided(spark, sf).orderBy(F.desc("s_star"), "vec_id").limit(100).select("vec_id", "y_hat")
    other = CG._decided(spark, sf, refs=CG.GA.rows(V.ref(spark, sf), "one_per_class")).select("vec_id", F.col("y_hat").alias("y"))
    return top.join(other, "vec_id").agg(F.count("*").alias("n"), F.count_if(F.col("y_hat") != F.col("y")).alias("changed"))


@query("encode_drift", "WITH e AS (SELECT label, embedding::DOUBLE[] AS z, list_transform(embedding, lambda x: floor(x::DOUBLE*16)/16) AS q FROM embeddings) SELECT label, count(*) AS n, round(avg(list_dot_product(z,q)/sqrt(list_dot_product(z,z)*list_dot_product(q,q))),6) AS mean, round(min(list_dot_product(z,q)/sqrt(list_dot_product(z,z)*list_dot_product(q,q))),6) AS lo FROM e GROUP BY 1")
def encode_drift(spark, sf):
    """Row-wise cosine of two encodings of the same rows: vectors and their sixteenths."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    e = e.withColumn("q", F.transform("z", lambda x: F.floor(x * 16) / 16))
    return e.select("label", (dot("z", "q") / F.sqrt(dot("z", "z") * dot("q", "q"))).alias("c")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("lo"))


@query("to_pixels", f"WITH {V.PRED}, c AS (SELECT scene_id, mask_no, (x0+x1)/1280 AS cx, (y0+y1)/960 AS cy, (x1-x0)/640 AS w, (y1-y0)/480 AS h, score FROM pred) SELECT scene_id, mask_no, round(least(greatest((cx-w/2)*640,0),640),6) AS x0, round(least(greatest((cy-h/2)*480,0),480),6) AS y0, round(least(greatest((cx+w/2)*640,0),640),6) AS x1, round(least(greatest((cy+h/2)*480,0),480),6) AS y1, round(1/(1+exp(-score)),9) AS p FROM c")
def to_pixels(spark, sf):
    """Boxes as centre and size in parts of a 640 x 480 frame, back in pixels and clipped; logits as probabilities."""
    c = V.pred(spark, sf).selectExpr("scene_id", "mask_no", "(x0+x1)/1280 cx", "(y0+y1)/960 cy", "(x1-x0)/640 w", "(y1-y0)/480 h", "score")
    clip = lambda x, top: F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(top)), 6)
    return c.select("scene_id", "mask_no", clip((F.col("cx") - F.col("w") / 2) * 640, 640.0).alias("x0"), clip((F.col("cy") - F.col("h") / 2) * 480, 480.0).alias("y0"), clip((F.col("cx") + F.col("w") / 2) * 640, 640.0).alias("x1"), clip((F.col("cy") + F.col("h") / 2) * 480, 480.0).alias("y1"), F.round(1 / (1 + F.exp(-F.col("score"))), 9).alias("p"))


@query("markdown_rows", "SELECT '| ' || r_name || ' | ' || count(n_nationkey) || ' | ' || coalesce(replace(printf('%.2f', avg(n_nationkey)), '.', ','), '—') || ' |' AS line FROM region LEFT JOIN nation ON n_regionkey=r_regionkey GROUP BY r_name")
def markdown_rows(spark, sf):
    """Records as lines of a Markdown table; a dash where there is no value."""
    r = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"), F.avg("n_nationkey").alias("m"))
    mean = F.coalesce(F.replace(F.format_string("%.2f", "m"), F.lit("."), F.lit(",")), F.lit("—"))
    return r.select(F.concat(F.lit("| "), F.concat_ws(" | ", "r_name", F.col("n").cast("string"), F.when(F.col("m").isNull(), "—").otherwise(mean)), F.lit(" |")).alias("line"))


@query("record_sink", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def record_sink(spark, sf):
    """Records as JSON lines in the shared folder, never overwritten, read back."""
    path = f"{fresh_folder(spark, 'records')}/lines"
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    rows.write.mode("errorifexists").json(path)
    return spark.read.schema(rows.schema).json(path)


@query("ar_scored", f"WITH RECURSIVE {CS.EVAL}, {CS.match_sql(least=0.5)} {CS.ar_sql('mt', 100)}")
def ar_scored(spark, sf):
    """Average recall of detections with a score of 0.5 or more."""
    m, g = CS._eval(spark, sf, 0.5)
    return M.average_recall(m, M.gt_counts(g), 100)


ETAS = (0.2, 0.3, 0.4)


@query("dedup_sweep", f"""WITH RECURSIVE {V.REF}, e(e, eta) AS (VALUES {", ".join(f"({i},{x})" for i, x in enumerate(ETAS))}), o AS MATERIALIZED (SELECT label_id, insert_no, z, row_number() OVER (PARTITION BY label_id ORDER BY insert_no)-1 AS rank FROM ref),
items AS MATERIALIZED (SELECT label_id*10+e AS grp, rank FROM o, e), pr AS MATERIALIZED (SELECT m.label_id, m.rank, n.rank AS b, list_dot_product(m.z,n.z) AS s FROM o m JOIN o n ON m.label_id=n.label_id AND n.rank<m.rank),
sup AS MATERIALIZED (SELECT label_id*10+e AS grp, rank, list(b) AS before FROM pr JOIN e ON s>=eta GROUP BY ALL), {CS.FIT}
SELECT eta::DOUBLE AS eta, count(*) AS kept FROM won JOIN e ON grp%10=e GROUP BY 1""")  # fmt: skip
def dedup_sweep(spark, sf):
    """Gallery rows that deduplication keeps at each threshold; the pairs are made once for all."""
    p = cut(CG._rivals(spark, sf, min(ETAS)))
    out = None
    for eta in ETAS:
        part = G.dedup(p, V.ref(spark, sf), eta).agg(F.count("*").alias("kept")).select(F.lit(eta).alias("eta"), "kept")
        out = part if out is None else out.unionByName(part)
    return out
