"""Queries on scenes: boxes, nesting, greedy selection, detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import greedy as G
from ..operators import metrics as M
from ..operators import nesting as N
from ..operators import stats as S
from . import views as V
from .cut import cut
from .registry import query

IOU = """(greatest(least(g.x1,m.x1)-greatest(g.x0,m.x0),0)*greatest(least(g.y1,m.y1)-greatest(g.y0,m.y0),0))"""
PAIR = f"""pr AS (SELECT g.scene_id, g.gt_no, g.gt_label, m.mask_no, m.label_id, {IOU} AS inter, (g.x1-g.x0)*(g.y1-g.y0) AS gt_area, (m.x1-m.x0)*(m.y1-m.y0) AS mask_area
 FROM gt g JOIN pred m ON g.scene_id=m.scene_id WHERE g.x0<m.x1 AND m.x0<g.x1 AND g.y0<m.y1 AND m.y0<g.y1),
p AS (SELECT *, inter/(gt_area+mask_area-inter) AS iou FROM pr)"""
SCENE = f"{V.PRED}, {V.GT}, {PAIR}"
BEST = "best AS (SELECT g.scene_id, g.gt_no, g.gt_label, (g.x1-g.x0)*(g.y1-g.y0) AS gt_area, coalesce(max(p.iou),0) AS best_iou FROM gt g LEFT JOIN p ON g.scene_id=p.scene_id AND g.gt_no=p.gt_no GROUP BY ALL)"
DIST = """d AS (SELECT m.scene_id, m.mask_no FROM pred m LEFT JOIN (SELECT scene_id, mask_no, max(iou) AS t FROM p GROUP BY ALL) t USING (scene_id, mask_no)
 WHERE coalesce(t,0)<0.1 AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.scene_id=m.scene_id AND m.x0<z.x1 AND z.x0<m.x1 AND m.y0<z.y1 AND z.y0<m.y1))"""
ABIN = "CASE WHEN gt_area<1024 THEN 0 WHEN gt_area<2048 THEN 1 ELSE 2 END"
NEST = """nr AS MATERIALIZED (SELECT m.scene_id, m.mask_no AS a, n.mask_no AS b, ((least(m.x1,n.x1)-greatest(m.x0,n.x0))*(least(m.y1,n.y1)-greatest(m.y0,n.y0)))::BIGINT AS v,
 ((m.x1-m.x0)*(m.y1-m.y0))::BIGINT AS area_a, ((n.x1-n.x0)*(n.y1-n.y0))::BIGINT AS area_b
 FROM pred m JOIN (SELECT scene_id, list({'mask_no': mask_no, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) AS own FROM pred GROUP BY scene_id) s USING (scene_id), (SELECT unnest(s.own) AS n)
 WHERE m.mask_no<>n.mask_no AND m.x0<n.x1 AND n.x0<m.x1 AND m.y0<n.y1 AND n.y0<m.y1),
nest AS MATERIALIZED (SELECT * FROM nr WHERE area_a<area_b AND 10*v>=9*area_a)"""
NESTED = f"{V.PRED}, {NEST}"
PARENT = "par AS (SELECT scene_id, a AS mask_no, b AS parent FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, a ORDER BY area_b, b) AS rn FROM nest) WHERE rn=1)"


def _two(spark, sf):
    return V.gt(spark, sf), V.pred(spark, sf)


@query("iou_pairs", f"WITH {SCENE} SELECT scene_id, gt_no, mask_no, iou FROM p WHERE iou>=0.5")
def iou_pairs(spark, sf):
    return B.pairs(*_two(spark, sf), 0.5).select("scene_id", "gt_no", "mask_no", "iou")


@query("best_iou_per_gt", f"WITH {SCENE}, {BEST} SELECT scene_id, gt_no, best_iou FROM best")
def best_iou_per_gt(spark, sf):
    return B.best_per_gt(*_two(spark, sf)).select("scene_id", "gt_no", "best_iou")


@query("recall_by_bin", f"WITH {SCENE}, {BEST} SELECT {ABIN} AS abin, count(*) AS n, count(*) FILTER (best_iou>=0.5) AS r50, count(*) FILTER (best_iou>=0.75) AS r75, round(count(*) FILTER (best_iou>=0.5)/count(*),9) AS recall FROM best GROUP BY 1")
def recall_by_bin(spark, sf):
    b = B.best_per_gt(*_two(spark, sf)).withColumn("abin", B.area_bin(F.col("gt_area")))
    return b.groupBy("abin").agg(F.count("*").alias("n"), F.count_if(F.col("best_iou") >= 0.5).alias("r50"), F.count_if(F.col("best_iou") >= 0.75).alias("r75"), F.round(F.count_if(F.col("best_iou") >= 0.5) / F.count("*"), 9).alias("recall"))


@query("distractors", f"WITH {SCENE}, {V.ZONES}, {DIST} SELECT * FROM d")
def distractors(spark, sf):
    return B.distractors(*_two(spark, sf), V.zones(spark, sf))


@query("multiplicity", f"WITH {SCENE}, c AS (SELECT scene_id, gt_no, count(*) AS any_, count(*) FILTER (label_id=gt_label) AS same FROM p WHERE iou>=0.5 GROUP BY ALL) SELECT count(*) FILTER (any_>=2) AS two_any, count(*) FILTER (same>=2) AS two_same, (SELECT count(*) FROM gt) AS n FROM c")
def multiplicity(spark, sf):
    g, m = _two(spark, sf)
    c = B.pairs(g, m, 0.5).groupBy("scene_id", "gt_no").agg(F.count("*").alias("any_"), F.count_if(F.col("label_id") == F.col("gt_label")).alias("same"))
    c = g.select("scene_id", "gt_no").join(c, ["scene_id", "gt_no"], "left")
    return c.agg(F.count_if(F.col("any_") >= 2).alias("two_any"), F.count_if(F.col("same") >= 2).alias("two_same"), F.count("*").alias("n"))


@query("composition_counts", f"WITH {V.PRED}, {V.GT}, x AS (SELECT CASE WHEN scene_id%4=0 THEN 'cal' ELSE 'test' END AS split, scene_id%3 AS level, (x1-x0)*(y1-y0) AS gt_area FROM gt) SELECT coalesce(split,'all') AS split, coalesce(level::VARCHAR,'all') AS level, count(*) AS n, count(*) FILTER ({ABIN}=0) AS small, count(*) FILTER ({ABIN}=1) AS medium, count(*) FILTER ({ABIN}=2) AS large FROM x GROUP BY CUBE(split, level)")
def composition_counts(spark, sf):
    a = B.area_bin((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    x = V.gt(spark, sf).select(F.when(F.col("scene_id") % 4 == 0, "cal").otherwise("test").alias("split"), (F.col("scene_id") % 3).cast("string").alias("level"), a.alias("abin"))
    c = x.cube("split", "level").agg(F.count("*").alias("n"), *(F.count_if(F.col("abin") == i).alias(n) for i, n in enumerate(("small", "medium", "large"))))
    return c.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("level", F.lit("all")).alias("level"), "n", "small", "medium", "large")


@query("inside_box", f"WITH {SCENE} SELECT g.scene_id, g.gt_no, coalesce(bool_or(p.inter>=0.9*p.mask_area AND p.mask_area>=0.05*p.gt_area),false) AS inside FROM gt g LEFT JOIN p ON g.scene_id=p.scene_id AND g.gt_no=p.gt_no GROUP BY ALL")
def inside_box(spark, sf):
    return B.inside(*_two(spark, sf))


@query("near_gt", f"WITH {SCENE} SELECT scene_id, mask_no, gt_no, iou FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, mask_no ORDER BY iou DESC, gt_no) AS rn FROM p WHERE iou>=0.1) WHERE rn=1")
def near_gt(spark, sf):
    return B.nearest_gt(*_two(spark, sf))


@query("area_range_counts", f"WITH {V.PRED}, {V.GT}, r(abin,lo,hi) AS (VALUES (0,0.0,1e10),(1,0.0,1023.5),(2,1024.0,2047.5),(3,2048.0,1e10)) SELECT gt_label AS cat, abin, count(*) AS n FROM gt JOIN r ON (x1-x0)*(y1-y0) BETWEEN lo AND hi GROUP BY ALL")
def area_range_counts(spark, sf):
    r = spark.createDataFrame([(0, 0.0, 1e10), (1, 0.0, 1023.5), (2, 1024.0, 2047.5), (3, 2048.0, 1e10)], "abin int, lo double, hi double")
    a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return V.gt(spark, sf).withColumn("a", a).join(F.broadcast(r), F.col("a").between(F.col("lo"), F.col("hi"))).groupBy(F.col("gt_label").alias("cat"), "abin").agg(F.count("*").alias("n"))


@query("zone_overlap", f"WITH {V.PRED}, {V.GT}, {V.ZONES}, h AS (SELECT DISTINCT z.scene_id AS zs, g.scene_id, g.gt_no FROM zones z JOIN gt g ON z.scene_id=g.scene_id AND g.x0<z.x1 AND z.x0<g.x1 AND g.y0<z.y1 AND z.y0<g.y1) SELECT (SELECT count(*) FROM zones) AS zones, (SELECT count(DISTINCT zs) FROM h) AS hit, (SELECT count(*) FROM gt) - (SELECT count(*) FROM h) AS gt_outside")
def zone_overlap(spark, sf):
    z, g = V.zones(spark, sf), V.gt(spark, sf)
    on = (F.col("z.scene_id") == F.col("g.scene_id")) & B.overlap("z", "g")
    hit = z.alias("z").join(g.alias("g"), on, "left_semi").agg(F.count("*").alias("hit"))
    out = g.alias("g").join(z.alias("z"), on, "left_anti").agg(F.count("*").alias("gt_outside"))
    return z.agg(F.count("*").alias("zones")).crossJoin(hit).crossJoin(out)


@query("gt_with_zones", f"WITH {V.PRED}, {V.GT}, {V.ZONES} SELECT scene_id, count(*) AS n, count(*) FILTER (c) AS crowd FROM (SELECT scene_id, false AS c FROM gt UNION ALL SELECT scene_id, true FROM zones) GROUP BY scene_id")
def gt_with_zones(spark, sf):
    u = V.gt(spark, sf).select("scene_id", F.lit(False).alias("c")).unionByName(V.zones(spark, sf).select("scene_id", F.lit(True).alias("c")))
    return u.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if("c").alias("crowd"))


@query("mask_batches", f"WITH {V.PRED} SELECT scene_id, (mask_no//16) AS batch, count(*) AS n, min(mask_no) AS first FROM pred GROUP BY ALL")
def mask_batches(spark, sf):
    return V.pred(spark, sf).groupBy("scene_id", F.expr("mask_no div 16").alias("batch")).agg(F.count("*").alias("n"), F.min("mask_no").alias("first"))


@query("square_crops", f"WITH {V.PRED} SELECT scene_id, mask_no, round_even(greatest(x1-x0,y1-y0)*1.5,0)::BIGINT AS side, round_even((x0+x1-round_even(greatest(x1-x0,y1-y0)*1.5,0))/2,0)::BIGINT AS x, round_even((y0+y1-round_even(greatest(x1-x0,y1-y0)*1.5,0))/2,0)::BIGINT AS y FROM pred")
def square_crops(spark, sf):
    s = B.square(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 1.5)
    return V.pred(spark, sf).select("scene_id", "mask_no", s["side"].alias("side"), s["x"].alias("x"), s["y"].alias("y"))


# ---- nesting ---------------------------------------------------------------------


@query("box_nesting", f"WITH {NESTED} SELECT scene_id, a, b, v, 5*area_a>=4*area_b AS near FROM nest")
def box_nesting(spark, sf):
    return N.nested(V.pred(spark, sf)).select("scene_id", "a", "b", "v", (5 * F.col("area_a") >= 4 * F.col("area_b")).alias("near"))


@query("nest_parent", f"WITH {NESTED}, {PARENT} SELECT * FROM par")
def nest_parent(spark, sf):
    return N.parents(N.nested(V.pred(spark, sf)))


@query("nest_position", f"WITH {NESTED}, {PARENT}, k AS (SELECT DISTINCT scene_id, parent AS mask_no FROM par) SELECT m.scene_id, m.mask_no, CASE WHEN p.parent IS NULL AND k.mask_no IS NULL THEN 'isolated' WHEN p.parent IS NULL THEN 'root' WHEN k.mask_no IS NULL THEN 'leaf' ELSE 'internal' END AS position FROM pred m LEFT JOIN par p USING (scene_id, mask_no) LEFT JOIN k USING (scene_id, mask_no)")
def nest_position(spark, sf):
    m = V.pred(spark, sf)
    return N.positions(m, N.nested(m))


@query("nest_transitivity", f"WITH {NESTED} SELECT p.scene_id, p.a, p.b AS m, q.b FROM nest p JOIN nest q ON p.scene_id=q.scene_id AND p.b=q.a WHERE NOT EXISTS (SELECT 1 FROM nest r WHERE r.scene_id=p.scene_id AND r.a=p.a AND r.b=q.b)")
def nest_transitivity(spark, sf):
    return N.intransitive(N.nested(V.pred(spark, sf))).select("scene_id", "a", "m", "b")


@query("chain_max", f"WITH {NESTED}, e AS (SELECT scene_id, a, b FROM nest UNION ALL SELECT scene_id, b, a FROM nest) SELECT scene_id, mask_no FROM pred m WHERE NOT EXISTS (SELECT 1 FROM e JOIN pred o ON o.scene_id=e.scene_id AND o.mask_no=e.b WHERE e.scene_id=m.scene_id AND e.a=m.mask_no AND (o.score>m.score OR (o.score=m.score AND o.mask_no<m.mask_no)))")
def chain_max(spark, sf):
    m = V.pred(spark, sf)
    return N.chain_max(m, N.nested(m))


@query("maximal_masks", f"WITH {NESTED} SELECT scene_id, mask_no FROM pred m WHERE NOT EXISTS (SELECT 1 FROM nest n WHERE n.scene_id=m.scene_id AND n.a=m.mask_no)")
def maximal_masks(spark, sf):
    m = V.pred(spark, sf)
    return N.maximal(m, N.nested(m))


@query("minimal_masks", f"WITH {NESTED} SELECT scene_id, mask_no FROM pred m WHERE NOT EXISTS (SELECT 1 FROM nest n WHERE n.scene_id=m.scene_id AND n.b=m.mask_no)")
def minimal_masks(spark, sf):
    m = V.pred(spark, sf)
    return N.minimal(m, N.nested(m))


@query("forest_depth", f"WITH RECURSIVE {NESTED}, {PARENT}, up AS (SELECT scene_id, mask_no, parent AS root, 1 AS depth FROM par UNION ALL SELECT u.scene_id, u.mask_no, p.parent, u.depth+1 FROM up u JOIN par p ON p.scene_id=u.scene_id AND p.mask_no=u.root) SELECT scene_id, mask_no, max(depth)::BIGINT AS depth, arg_max(root, depth) AS root FROM up GROUP BY ALL")
def forest_depth(spark, sf):
    return N.depths(N.nested(V.pred(spark, sf)))


@query("forest_ancestors", f"WITH RECURSIVE {NESTED}, {PARENT}, up AS (SELECT scene_id, mask_no, parent AS ancestor, 1 AS generation FROM par UNION ALL SELECT u.scene_id, u.mask_no, p.parent, u.generation+1 FROM up u JOIN par p ON p.scene_id=u.scene_id AND p.mask_no=u.ancestor) SELECT scene_id, mask_no, ancestor, generation::BIGINT AS generation FROM up")
def forest_ancestors(spark, sf):
    return N.ancestors(N.nested(V.pred(spark, sf)))


RHO = f"""{NESTED}, nd AS (SELECT scene_id, a, b FROM nest WHERE 5*area_a>=4*area_b), nd2 AS (SELECT scene_id, a, b FROM nd UNION SELECT scene_id, b, a FROM nd),
reach AS (SELECT scene_id, a, a AS b FROM nd2 UNION SELECT r.scene_id, r.a, n.b FROM reach r JOIN nd2 n ON n.scene_id=r.scene_id AND n.a=r.b),
comp AS (SELECT m.scene_id, m.mask_no, coalesce(min(r.b), m.mask_no) AS comp, any_value((m.x1-m.x0)*(m.y1-m.y0)) AS area FROM pred m LEFT JOIN reach r ON r.scene_id=m.scene_id AND r.a=m.mask_no GROUP BY m.scene_id, m.mask_no),
bad AS (SELECT DISTINCT n.scene_id, ca.comp FROM nest n JOIN comp ca ON ca.scene_id=n.scene_id AND ca.mask_no=n.a JOIN comp cb ON cb.scene_id=n.scene_id AND cb.mask_no=n.b WHERE ca.comp<>cb.comp),
rho AS (SELECT scene_id, mask_no FROM (SELECT c.*, row_number() OVER (PARTITION BY scene_id, comp ORDER BY area, mask_no) AS rn FROM comp c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.scene_id=c.scene_id AND b.comp=c.comp)) WHERE rn=1)"""


@query("rho_select", f"WITH RECURSIVE {RHO} SELECT * FROM rho")
def rho_select(spark, sf):
    return N.select(V.pred(spark, sf))


@query("rho_record", f"WITH RECURSIVE {RHO}, n1 AS (SELECT scene_id, count(*) AS masks FROM pred GROUP BY 1), n2 AS (SELECT scene_id, count(*) AS c FROM rho GROUP BY 1), n3 AS (SELECT scene_id, count(*) AS c, count(*) FILTER (5*area_a>=4*area_b) AS near FROM nest GROUP BY 1), n4 AS (SELECT scene_id, count(DISTINCT comp) AS c FROM comp GROUP BY 1), n5 AS (SELECT scene_id, count(*) AS c FROM nr WHERE a<b AND area_a=area_b AND 10*v>=9*area_a GROUP BY 1) SELECT scene_id, masks, coalesce(n2.c,0) AS selected, coalesce(n3.c,0) AS nested_pairs, coalesce(n3.near,0) AS near_pairs, n4.c AS groups, coalesce(n5.c,0) AS equal_area FROM n1 LEFT JOIN n2 USING (scene_id) LEFT JOIN n3 USING (scene_id) JOIN n4 USING (scene_id) LEFT JOIN n5 USING (scene_id)")
def rho_record(spark, sf):
    """The selection's counters, scene by scene."""
    return N.record(V.pred(spark, sf))


@query("rho_violations", f"WITH RECURSIVE {RHO} SELECT count(*) AS n FROM nest n JOIN rho a ON a.scene_id=n.scene_id AND a.mask_no=n.a JOIN rho b ON b.scene_id=n.scene_id AND b.mask_no=n.b")
def rho_violations(spark, sf):
    m = V.pred(spark, sf)
    return N.violations(N.select(m), N.nested(m)).agg(F.count("*").alias("n"))


@query("recall_after_selection", f"WITH RECURSIVE {RHO}, {V.GT}, {PAIR}, b AS (SELECT g.scene_id, g.gt_no, coalesce(max(p.iou),0) AS best FROM gt g LEFT JOIN (SELECT p.* FROM p JOIN rho USING (scene_id, mask_no)) p ON p.scene_id=g.scene_id AND p.gt_no=g.gt_no GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (best>=0.5) AS found FROM b")
def recall_after_selection(spark, sf):
    g, m = _two(spark, sf)
    kept = m.join(N.select(m), ["scene_id", "mask_no"], "left_semi")
    return B.best_per_gt(g, kept).agg(F.count("*").alias("n"), F.count_if(F.col("best_iou") >= 0.5).alias("found"))


@query("nest_width")
def nest_width(spark, sf):
    m = V.pred(spark, sf)
    return N.widths(m, N.nested(m))


CUT = f"""{NESTED}, {PARENT}, fam AS (SELECT scene_id, parent, count(*) AS kids FROM par GROUP BY ALL HAVING count(*)>=2),
px AS (SELECT DISTINCT f.scene_id, f.parent, x, y FROM fam f JOIN par p ON p.scene_id=f.scene_id AND p.parent=f.parent JOIN pred m ON m.scene_id=f.scene_id AND m.mask_no=p.mask_no JOIN pred q ON q.scene_id=f.scene_id AND q.mask_no=f.parent,
 unnest(range(greatest(m.x0,q.x0)::BIGINT, least(m.x1,q.x1)::BIGINT)) a(x), unnest(range(greatest(m.y0,q.y0)::BIGINT, least(m.y1,q.y1)::BIGINT)) b(y)),
gives AS (SELECT c.scene_id, c.parent AS mask_no FROM (SELECT scene_id, parent, count(*) AS c FROM px GROUP BY ALL) c JOIN pred q ON q.scene_id=c.scene_id AND q.mask_no=c.parent WHERE c.c>=0.5*(q.x1-q.x0)*(q.y1-q.y0)),
seen AS (SELECT m.scene_id, m.mask_no FROM pred m WHERE NOT EXISTS (SELECT 1 FROM par p WHERE p.scene_id=m.scene_id AND p.mask_no=m.mask_no)
 UNION ALL SELECT p.scene_id, p.mask_no FROM seen s JOIN gives g ON g.scene_id=s.scene_id AND g.mask_no=s.mask_no JOIN par p ON p.scene_id=s.scene_id AND p.parent=s.mask_no),
held AS (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM gives g WHERE g.scene_id=s.scene_id AND g.mask_no=s.mask_no))"""


@query("forest_split", f"WITH RECURSIVE {CUT} SELECT scene_id, mask_no FROM held h WHERE NOT EXISTS (SELECT 1 FROM nest n JOIN held k ON k.scene_id=n.scene_id AND k.mask_no=n.b WHERE n.scene_id=h.scene_id AND n.a=h.mask_no)")
def forest_split(spark, sf):
    m = V.pred(spark, sf)
    return N.split(m, N.nested(m))


# ---- masks as runs --------------------------------------------------------------------

SIDE = 720  # height of the frame
NOTCH = "floor((x1-x0)/2)", "floor((y1-y0)/2)"


def _notched(x):
    """Boxes as runs, every second one without its upper right quarter."""
    import numpy as np

    from ..functions import runs as U

    box = np.stack([x[c] for c in N.BOX], axis=1).astype(np.int64)
    size = (box[:, 2:] - box[:, :2]) // 2
    return U.from_boxes(box, SIDE, np.where((x["mask_no"] % 2 == 1)[:, None], size, 0))


def _shapes(spark, sf):
    """The masks and the shape that makes runs of them."""
    from ..operators import masks as K

    return V.pred(spark, sf), K.Shape(("x0", "y0", "x1", "y1"), _notched, SIDE)


_CORNER = "greatest(least(m.{a}1,n.{b}1)-greatest(m.{a}0,n.{b}0),0)*greatest(least(m.{a}3,n.{b}3)-greatest(m.{a}2,n.{b}2),0)"
SHAPES = f"""shp AS MATERIALIZED (SELECT scene_id, mask_no, x0 AS o0, x1 AS o1, y0 AS o2, y1 AS o3, CASE WHEN mask_no%2=1 THEN x1-{NOTCH[0]} ELSE x1 END AS c0, x1 AS c1, y0 AS c2, CASE WHEN mask_no%2=1 THEN y0+{NOTCH[1]} ELSE y0 END AS c3 FROM pred),
sar AS MATERIALIZED (SELECT *, ((o1-o0)*(o3-o2)-(c1-c0)*(c3-c2))::BIGINT AS area FROM shp),
spr AS MATERIALIZED (SELECT m.scene_id, m.mask_no AS a, n.mask_no AS b, m.area AS area_a, n.area AS area_b, ({_CORNER.format(a='o', b='o')}-{_CORNER.format(a='o', b='c')}-{_CORNER.format(a='c', b='o')}+{_CORNER.format(a='c', b='c')})::BIGINT AS v
 FROM sar m JOIN (SELECT scene_id, list({{'mask_no': mask_no, 'area': area, 'o0': o0, 'o1': o1, 'o2': o2, 'o3': o3, 'c0': c0, 'c1': c1, 'c2': c2, 'c3': c3}}) AS own FROM sar GROUP BY scene_id) s USING (scene_id), (SELECT unnest(s.own) AS n) WHERE m.area<n.area)"""


@query("mask_nesting", f"WITH {V.PRED}, {SHAPES} SELECT scene_id, a, b, v, area_a, area_b FROM spr WHERE v>0 AND 10*v>=9*area_a")
def mask_nesting(spark, sf):
    """Nested masks that are no boxes, from their runs."""
    from ..operators import masks as K

    m, shape = _shapes(spark, sf)
    return K.nested(m, shape=shape)


@query("mask_overlaps", f"WITH {V.PRED}, {SHAPES}, e AS (SELECT m.scene_id, m.mask_no AS i, n.mask_no AS k, m.area AS area_i, n.area AS area_k, ({_CORNER.format(a='o', b='o')}-{_CORNER.format(a='o', b='c')}-{_CORNER.format(a='c', b='o')}+{_CORNER.format(a='c', b='c')})::BIGINT AS v FROM sar m JOIN (SELECT scene_id, list({{'mask_no': mask_no, 'area': area, 'o0': o0, 'o1': o1, 'o2': o2, 'o3': o3, 'c0': c0, 'c1': c1, 'c2': c2, 'c3': c3}}) AS own FROM sar GROUP BY scene_id) s USING (scene_id), (SELECT unnest(s.own) AS n) WHERE m.mask_no<n.mask_no) SELECT scene_id, count(*) AS pairs, sum(v)::BIGINT AS shared, round(max(v/(area_i+area_k-v)),9) AS top_iou FROM e WHERE v>0 GROUP BY 1")
def mask_overlaps(spark, sf):
    """By scene: pairs of masks that share pixels, the pixels, the largest IoU."""
    from ..operators import masks as K

    p = K.shared(*_shapes(spark, sf))
    return p.groupBy("scene_id").agg(F.count("*").alias("pairs"), F.sum("v").alias("shared"), F.round(F.max(F.col("v") / (F.col("area_i") + F.col("area_k") - F.col("v"))), 9).alias("top_iou"))


@query("mask_crossings", f"WITH {V.PRED}, {SHAPES}, e AS (SELECT m.scene_id, m.mask_no AS i, n.mask_no AS k, m.area AS area_i, n.area AS area_k, ({_CORNER.format(a='o', b='o')}-{_CORNER.format(a='o', b='c')}-{_CORNER.format(a='c', b='o')}+{_CORNER.format(a='c', b='c')})::BIGINT AS v FROM sar m JOIN (SELECT scene_id, list({{'mask_no': mask_no, 'area': area, 'o0': o0, 'o1': o1, 'o2': o2, 'o3': o3, 'c0': c0, 'c1': c1, 'c2': c2, 'c3': c3}}) AS own FROM sar GROUP BY scene_id) s USING (scene_id), (SELECT unnest(s.own) AS n) WHERE m.mask_no<n.mask_no) SELECT scene_id, i, k, v FROM e WHERE v>0 AND 10*v<9*least(area_i, area_k)")
def mask_crossings(spark, sf):
    """Pairs of masks that cross: they share pixels, and neither lies in the other."""
    from ..operators import masks as K

    m, shape = _shapes(spark, sf)
    return K.crossings(m, shape=shape).select("scene_id", "i", "k", "v")


STRIPS = """xs AS (SELECT DISTINCT scene_id, unnest([x0, x1]) AS x FROM pred), st AS MATERIALIZED (SELECT scene_id, x AS xa, lead(x) OVER (PARTITION BY scene_id ORDER BY x) AS xb FROM xs),
sb AS (SELECT s.scene_id, s.xa, s.xb, b.y0, b.y1 FROM st s JOIN (SELECT scene_id, list({'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}) AS own FROM pred GROUP BY scene_id) p USING (scene_id), (SELECT unnest(p.own) AS b) WHERE s.xb IS NOT NULL AND b.x0<=s.xa AND b.x1>=s.xb),
sw AS (SELECT scene_id, xb-xa AS w, y0, y1, max(y1) OVER (PARTITION BY scene_id, xa ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM sb),
cv AS (SELECT scene_id, sum(w*greatest(0, y1-greatest(y0, coalesce(up, y0))))::BIGINT AS covered FROM sw GROUP BY 1)"""


@query("mask_redundancy", f"WITH {V.PRED}, {STRIPS}, t AS (SELECT scene_id, count(*) AS masks, sum((x1-x0)*(y1-y0))::BIGINT AS total FROM pred GROUP BY 1) SELECT scene_id, masks, total, covered, round(1-covered/total,9) AS redundancy FROM t JOIN cv USING (scene_id)")
def mask_redundancy(spark, sf):
    """By scene: pixels of all masks, pixels that any covers, and the share that is covered again."""
    from ..operators import masks as K

    c = K.coverage(V.pred(spark, sf), K.Shape(N.BOX, N.box_shape))
    return c.select("scene_id", "masks", "total", "covered", F.round(1 - F.col("covered") / F.col("total"), 9).alias("redundancy"))


# ---- greedy ------------------------------------------------------------------------

FIT = """fit AS (SELECT grp, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT grp FROM items)
 UNION ALL SELECT f.grp, f.k+1, CASE WHEN s.before IS NOT NULL AND list_has_any(f.kept, s.before) THEN f.kept ELSE list_append(f.kept, f.k) END
 FROM fit f JOIN items i ON i.grp=f.grp AND i.rank=f.k LEFT JOIN sup s ON s.grp=f.grp AND s.rank=f.k),
won AS (SELECT grp, unnest(kept) AS rank FROM (SELECT grp, arg_max(kept, k) AS kept FROM fit GROUP BY grp))"""


@query("box_nms", f"""WITH RECURSIVE {V.PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, mask_no)-1 AS rank FROM pred),
items AS MATERIALIZED (SELECT scene_id AS grp, rank FROM r),
sup AS MATERIALIZED (SELECT m.scene_id AS grp, m.rank, list(g.rank) AS before FROM r m JOIN r g ON m.scene_id=g.scene_id AND g.rank<m.rank WHERE {IOU}/((g.x1-g.x0)*(g.y1-g.y0)+(m.x1-m.x0)*(m.y1-m.y0)-{IOU})>0.3 GROUP BY ALL), {FIT}
SELECT r.scene_id, r.mask_no FROM won JOIN r ON r.scene_id=won.grp AND r.rank=won.rank""")  # fmt: skip
def box_nms(spark, sf):
    return G.box_nms(V.pred(spark, sf))


ORACLE = f"""{SCENE}, c AS (SELECT scene_id, gt_no, mask_no, row_number() OVER (PARTITION BY scene_id ORDER BY iou DESC, gt_no, mask_no)-1 AS rank FROM p WHERE iou>=0.5),
items AS MATERIALIZED (SELECT scene_id AS grp, rank FROM c), sup AS MATERIALIZED (SELECT m.scene_id AS grp, m.rank, list(n.rank) AS before FROM c m JOIN c n ON m.scene_id=n.scene_id AND n.rank<m.rank AND (m.gt_no=n.gt_no OR m.mask_no=n.mask_no) GROUP BY ALL), {FIT},
oracle AS (SELECT g.scene_id, g.gt_no, g.gt_label, (g.x1-g.x0)*(g.y1-g.y0) AS gt_area, coalesce(x.mask_no,-1) AS mask_no FROM gt g LEFT JOIN (SELECT c.* FROM c JOIN won ON c.scene_id=won.grp AND c.rank=won.rank) x ON x.scene_id=g.scene_id AND x.gt_no=g.gt_no)"""


@query("oracle_assign", f"WITH RECURSIVE {ORACLE} SELECT scene_id, gt_no, mask_no FROM oracle")
def oracle_assign(spark, sf):
    return G.oracle_assign(*_two(spark, sf))


@query("top1_by_bin", f"WITH RECURSIVE {ORACLE} SELECT coalesce(({ABIN})::VARCHAR,'all') AS abin, count(*) AS n, count(*) FILTER (m.label_id=o.gt_label) AS hit FROM oracle o JOIN pred m ON m.scene_id=o.scene_id AND m.mask_no=o.mask_no GROUP BY GROUPING SETS ((),({ABIN}))")
def top1_by_bin(spark, sf):
    g, m = _two(spark, sf)
    o = G.oracle_assign(g, m).join(g, ["scene_id", "gt_no"]).join(m.select("scene_id", "mask_no", "label_id"), ["scene_id", "mask_no"])
    x = o.select(B.area_bin((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("string").alias("abin"), (F.col("label_id") == F.col("gt_label")).alias("hit"))
    return x.rollup("abin").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit")).withColumn("abin", F.coalesce("abin", F.lit("all")))


# ---- detection metrics ---------------------------------------------------------------

RANGES = (("all", 0.0, 1e10), ("small", 0.0, 1023.5), ("medium", 1024.0, 2047.5), ("large", 2048.0, 1e10))
_THR = ", ".join(f"({i},{float(t)!r}::DOUBLE)" for i, t in enumerate(M.IOU_THRESHOLDS))
_POINTS = ", ".join(f"({float(x)!r}::DOUBLE)" for x in M.RECALL_POINTS)
EVAL = f"""{V.PRED}, {V.GT}, {V.ZONES}, thrs(thr, least) AS (VALUES {_THR}), points(x) AS (VALUES {_POINTS}),
truth AS (SELECT scene_id, gt_no, gt_label, false AS crowd, x0, y0, x1, y1 FROM gt UNION ALL SELECT scene_id, -1, gt_label, true, x0, y0, x1, y1 FROM zones, (SELECT DISTINCT gt_label FROM gt))"""


def match_sql(name: str = "mt", by_category: bool = True, lo: float = 0.0, hi: float = 1e10, max_det: int = 100, least: float = 0.0, src: str = "pred") -> str:
    """CTEs that end in ``name``: the matches of EVAL, detection by detection.

    The state of a group is the list of taken boxes. A detection's boxes come in
    order of choice, those to ignore last; crowds carry negative numbers, which are never taken.
    """
    cat, own, n = ("label_id", "gt_label", name) if by_category else ("0", "0", name)
    return f"""{n}_g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scene_id, cat ORDER BY skip, gt_no) AS j FROM (SELECT scene_id, {own} AS cat, gt_no, crowd, x0, y0, x1, y1, (x1-x0)*(y1-y0) AS area, crowd OR (x1-x0)*(y1-y0)<{lo} OR (x1-x0)*(y1-y0)>{hi} AS skip FROM truth)),
{n}_d AS MATERIALIZED (SELECT * FROM (SELECT scene_id, {cat} AS cat, score, x0, y0, x1, y1, (x1-x0)*(y1-y0) AS area, row_number() OVER (PARTITION BY scene_id, {cat} ORDER BY score DESC, mask_no)-1 AS rank FROM {src} WHERE score>={least}) WHERE rank<{max_det}),
{n}_p AS (SELECT *, inter/CASE WHEN crowd THEN mask_area ELSE mask_area+gt_area-inter END AS iou FROM (SELECT m.scene_id, m.cat, m.rank, g.j, g.skip, g.crowd, m.area AS mask_area, g.area AS gt_area, {IOU} AS inter FROM {n}_d m JOIN {n}_g g ON m.scene_id=g.scene_id AND m.cat=g.cat WHERE g.x0<m.x1 AND m.x0<g.x1 AND g.y0<m.y1 AND m.y0<g.y1)),
{n}_c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scene_id, cat, thr ORDER BY rank) AS k FROM (SELECT scene_id, cat, thr, rank, list(CASE WHEN crowd THEN -j ELSE j END ORDER BY skip, iou DESC, j DESC) AS js FROM {n}_p JOIN thrs ON iou>=least GROUP BY ALL)),
{n}_s AS (SELECT DISTINCT scene_id, cat, thr, 0::BIGINT AS k, []::BIGINT[] AS taken, -1::BIGINT AS rank, NULL::BIGINT AS pick FROM {n}_c
 UNION ALL SELECT scene_id, cat, thr, k, CASE WHEN free[1]>0 THEN list_append(taken, free[1]) ELSE taken END, rank, free[1] FROM (SELECT c.scene_id, c.cat, c.thr, c.k, s.taken, c.rank, [x for x in c.js if NOT list_contains(s.taken, x)] AS free FROM {n}_s s JOIN {n}_c c ON c.scene_id=s.scene_id AND c.cat=s.cat AND c.thr=s.thr AND c.k=s.k+1)),
{n} AS MATERIALIZED (SELECT d.scene_id, d.cat::INT AS cat, d.rank, d.score, t.thr::INT AS thr, g.j IS NOT NULL AS matched, coalesce(g.skip, d.area<{lo} OR d.area>{hi}) AS ignored, coalesce(g.gt_no, -1) AS gt_no
 FROM {n}_d d CROSS JOIN thrs t LEFT JOIN {n}_s s ON s.scene_id=d.scene_id AND s.cat=d.cat AND s.thr=t.thr AND s.rank=d.rank LEFT JOIN {n}_g g ON g.scene_id=s.scene_id AND g.cat=s.cat AND g.j=abs(s.pick)),
{n}_n AS (SELECT cat, count(*) AS npig FROM {n}_g WHERE NOT skip GROUP BY cat)"""


def ap_sql(name: str = "mt") -> str:
    """CTE ``name``_ap: AP of the matches ``name`` by cat."""
    return f"""{name}_pr AS (SELECT cat, thr, recall, max(prec) AS prec FROM (SELECT m.cat, thr, sum(matched::INT) OVER w/npig AS recall, sum(matched::INT) OVER w/(count(*) OVER w+2.220446049250313e-16) AS prec FROM {name} m JOIN {name}_n USING (cat) WHERE NOT ignored WINDOW w AS (PARTITION BY m.cat, thr ORDER BY score DESC, scene_id, rank ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
{name}_ap AS (SELECT n.cat, n.npig, coalesce(a.ap, 0) AS ap FROM {name}_n n LEFT JOIN (SELECT cat, sum(p)/1010 AS ap FROM (SELECT cat, thr, x, max(prec) AS p FROM {name}_pr JOIN points ON x<=recall GROUP BY ALL) GROUP BY cat) a USING (cat))"""


def ar_sql(name: str, k: int) -> str:
    return f"SELECT {k} AS max_det, round(avg(r),9) AS ar FROM (SELECT n.cat, (SELECT count(*) FROM {name} m WHERE m.cat=n.cat AND matched AND NOT ignored AND rank<{k})/npig/10 AS r FROM {name}_n n)"


_BY_AREA = " UNION ALL ".join(f"SELECT round(avg(ap),9) AS ap, count(*) AS cats, '{n}' AS area FROM m_{n}_ap" for n, _, _ in RANGES)


def _truth(spark, sf):
    """Detections, and ground truth with the ignore zones as crowds of every category."""
    d = V.pred(spark, sf).withColumnRenamed("mask_no", "det_no")
    g = V.gt(spark, sf).withColumn("iscrowd", F.lit(False))
    cats = g.select("gt_label").distinct().agg(F.collect_set("gt_label").alias("cats"))  # one row of the labels
    zone = V.zones(spark, sf).crossJoin(F.broadcast(cats)).select("scene_id", F.lit(-1).cast("long").alias("gt_no"), F.explode("cats").alias("gt_label"), "x0", "y0", "x1", "y1", F.lit(True).alias("iscrowd"))
    return d, g.unionByName(zone)


def _eval(spark, sf, least: float = 0.0, by_category: bool = True, **kw):
    d, g = _truth(spark, sf)
    return M.packed(d.filter(F.col("score") >= least), g, by_category, **kw), g


@query("coco_matches", f"WITH RECURSIVE {EVAL}, {match_sql()} SELECT * FROM mt")
def coco_matches(spark, sf):
    return M.by_threshold(_eval(spark, sf, gt_no=True)[0]).drop("area")


@query("tp_counts", f"WITH RECURSIVE {EVAL}, {match_sql()} SELECT cat, thr, count(*) FILTER (matched AND NOT ignored) AS tp, count(*) FILTER (NOT matched AND NOT ignored) AS fp FROM mt GROUP BY ALL")
def tp_counts(spark, sf):
    m = M.by_threshold(_eval(spark, sf)[0])
    return m.groupBy("cat", "thr").agg(F.count_if(F.col("matched") & ~F.col("ignored")).alias("tp"), F.count_if(~F.col("matched") & ~F.col("ignored")).alias("fp"))


@query("ap_by_category", f"WITH RECURSIVE {EVAL}, {match_sql()}, {ap_sql()} SELECT cat, npig, round(ap,9) AS ap FROM mt_ap")
def ap_by_category(spark, sf):
    m, g = _eval(spark, sf)
    return M.average_precision(m, M.gt_counts(g), bounds=M.score_bounds(V.pred(spark, sf))).withColumn("ap", F.round("ap", 9))


@query("ap_by_area", f"WITH RECURSIVE {EVAL}, {', '.join(match_sql(f'm_{n}', lo=lo, hi=hi) + ', ' + ap_sql(f'm_{n}') for n, lo, hi in RANGES)} {_BY_AREA}")
def ap_by_area(spark, sf):
    d, g = _truth(spark, sf)
    m = M.packed(d, g, ranges=RANGES, counted=True)
    ap = M.ap_by_threshold(m, M.area_counts(g, RANGES), ["area", "cat"], bounds=M.score_bounds(d))
    return ap.groupBy("area").agg(F.round(F.avg(M.mean_of(F.col("aps"))), 9).alias("ap"), F.count("*").alias("cats"))


def _recalls(m, n, at):
    out = None
    for k in at:
        part = M.average_recall(m, n, k)
        out = part if out is None else out.unionByName(part)
    return out


@query("ar_at_maxdets", f"WITH RECURSIVE {EVAL}, {match_sql()} {' UNION ALL '.join(ar_sql('mt', k) for k in (1, 10, 100))}")
def ar_at_maxdets(spark, sf):
    m, g = _eval(spark, sf)
    return _recalls(m, M.gt_counts(g), (1, 10, 100))


@query("proposal_recall", f"WITH RECURSIVE {EVAL}, {match_sql(by_category=False, max_det=1000)} {' UNION ALL '.join(ar_sql('mt', k) for k in (100, 1000))}")
def proposal_recall(spark, sf):
    m, g = _eval(spark, sf, by_category=False, max_det=1000)
    return _recalls(m, M.gt_counts(g.withColumn("gt_label", F.lit(0))), (100, 1000))


@query("boot_ap", f"""WITH RECURSIVE {EVAL}, {match_sql()}, {V.boot_sql('gt')}, wg AS (SELECT b, cat, sum(w) AS npig FROM mt_g JOIN boot USING (scene_id) WHERE NOT skip GROUP BY ALL),
pr AS (SELECT b, cat, thr, recall, max(prec) AS prec FROM (SELECT b, m.cat, thr, sum(w*matched::INT) OVER o/npig AS recall, sum(w*matched::INT) OVER o/(sum(w) OVER o+2.220446049250313e-16) AS prec FROM mt m JOIN boot USING (scene_id) JOIN wg USING (b, cat) WHERE NOT ignored WINDOW o AS (PARTITION BY b, m.cat, thr ORDER BY score DESC, scene_id, rank ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
ap AS (SELECT b, cat, sum(p)/1010 AS ap FROM (SELECT b, cat, thr, x, max(prec) AS p FROM pr JOIN points ON x<=recall GROUP BY ALL) GROUP BY ALL), v AS (SELECT b, avg(coalesce(ap,0)) AS value FROM wg LEFT JOIN ap USING (b, cat) GROUP BY b)
SELECT count(*) AS replicates, round(quantile_cont(value,0.025),6) AS lo, round(quantile_cont(value,0.975),6) AS hi FROM v""")
def boot_ap(spark, sf):
    return _boot_ap(spark, sf, 50)


@query("boot_ap_ci")
def boot_ap_ci(spark, sf):
    """boot_ap with 1,000 replicates."""
    return _boot_ap(spark, sf, 1000)


def _boot_ap(spark, sf, replicates: int):
    m, g = _eval(spark, sf)
    ap = M.bootstrap_ap(m, M.gt_counts(g), V.boot(g, replicates) if replicates < M.MANY else V.boot_vectors(g, replicates), replicates, M.score_bounds(V.pred(spark, sf)))
    return ap.groupBy("b").agg(F.avg("ap").alias("value")).agg(F.count("*").alias("replicates"), *S.interval("value"))


@query("boot_recall_ci", f"WITH {SCENE}, {BEST}, {V.boot_sql('gt')}, s AS (SELECT scene_id, count(*) FILTER (best_iou>=0.75) AS num, count(*) AS den FROM best GROUP BY 1), v AS (SELECT b, sum(w*num)/sum(w*den) AS value FROM s JOIN boot USING (scene_id) GROUP BY b) SELECT round(quantile_cont(value,0.025),6) AS lo, round(quantile_cont(value,0.975),6) AS hi, count(*) AS n FROM v")
def boot_recall_ci(spark, sf):
    g, m = _two(spark, sf)
    s = B.best_per_gt(g, m).groupBy("scene_id").agg(F.count_if(F.col("best_iou") >= 0.75).alias("num"), F.count("*").alias("den"))
    return S.ratio_bootstrap(s, V.boot(g)).agg(*S.interval("value"), F.count("*").alias("n"))


@query("paired_recall_diff", f"WITH RECURSIVE {RHO}, {V.GT}, {PAIR}, {BEST}, {V.boot_sql('gt')}, k AS (SELECT g.scene_id, g.gt_no, coalesce(max(p.iou),0) AS best FROM gt g LEFT JOIN (SELECT p.* FROM p JOIN rho USING (scene_id, mask_no)) p ON p.scene_id=g.scene_id AND p.gt_no=g.gt_no GROUP BY ALL), s AS (SELECT scene_id, count(*) FILTER (k.best>=0.5) AS a, count(*) FILTER (best.best_iou>=0.5) AS f, count(*) AS den FROM best JOIN k USING (scene_id, gt_no) GROUP BY 1), v AS (SELECT b, sum(w*a)/sum(w*den) - sum(w*f)/sum(w*den) AS value FROM s JOIN boot USING (scene_id) GROUP BY b), ci AS (SELECT round(quantile_cont(value,0.025),6) AS lo, round(quantile_cont(value,0.975),6) AS hi FROM v) SELECT lo, hi, CASE WHEN lo>0 THEN 1 WHEN hi<0 THEN 3 ELSE 2 END AS outcome FROM ci")
def paired_recall_diff(spark, sf):
    from ..operators.rules import outcome

    per = cut(N.found(*_two(spark, sf)))
    sums = S.weighted_sums(per, V.boot_vectors(per, 50), 50, ["den", "every", "rho"], [])
    d = sums.select((F.try_divide("rho", "den") - F.try_divide("every", "den")).alias("value")).agg(*S.interval("value"))
    return d.withColumn("outcome", outcome(F.col("lo"), F.col("hi")))


@query("voc_parse", f"WITH {V.PRED}, {V.GT} SELECT scene_id, gt_no, gt_label, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM gt")
def voc_parse(spark, sf):
    from ..sources.voc import parse, render

    return parse(render(V.gt(spark, sf))).select(F.col("filename").cast("long").alias("scene_id"), F.col("pos").cast("long").alias("gt_no"), F.col("name").cast("int").alias("gt_label"), "x0", "y0", "x1", "y1")
