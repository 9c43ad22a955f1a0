"""Queries of decision rules, each on results that other operators have made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import calibration as C
from ..operators import greedy as G
from ..operators import metrics as M
from ..operators import nesting as N
from ..operators import ranks as RK
from ..operators import rules as R
from ..operators import search as SE
from ..operators import stats as S
from . import catalog_eval as CE
from . import catalog_gallery as CG
from . import catalog_reports as CR
from . import catalog_scenes as CS
from . import views as V
from .cut import cut
from .registry import query

# ---- the gallery's growth ------------------------------------------------------------------


@query("predicted_ratio", f"WITH {V.REF}, {V.CHAIN}, c AS (SELECT label_id, count(*) AS c FROM ref GROUP BY 1), s AS (SELECT r, n, sum(c)::BIGINT AS refs FROM chain JOIN c USING (label_id), (VALUES (3),(5),(10)) z(n) WHERE pos<n GROUP BY ALL) SELECT a.r, a.n AS n0, b.n, round((1-pow(0.95, b.refs/a.refs))/0.05,9) AS ratio FROM s a JOIN s b ON a.r=b.r AND a.n<b.n")
def predicted_ratio(spark, sf):
    """How far the false-positive rate of a frozen threshold should rise over its level, by chain and growth."""
    c = V.ref(spark, sf).groupBy("label_id").agg(F.count("*").alias("c"))
    sizes = spark.createDataFrame([(n,) for n in CE.SIZES], "n int")
    s = V.chain(spark, sf).join(c, "label_id").join(F.broadcast(sizes), F.col("pos") < F.col("n")).groupBy("r", "n").agg(F.sum("c").alias("refs"))
    pair = s.select("r", F.col("n").alias("n0"), F.col("refs").alias("refs0")).join(s, "r").filter("n0 < n")
    return pair.select("r", "n0", "n", F.round(C.predicted_ratio(0.05, F.col("refs"), F.col("refs0")), 9).alias("ratio"))


@query("verdict_transfer", f"WITH {CG.SIM}, {CG.BYLABEL}, {V.CHAIN}, m AS (SELECT c.r, z.n, b.vec_id, b.scene_id, max(b.s) AS s FROM bl b JOIN chain c USING (label_id) JOIN (VALUES (3),(5),(10)) z(n) ON c.pos<z.n WHERE NOT known GROUP BY ALL), t AS (SELECT r, n, quantile_cont(s,0.95) AS tau FROM m WHERE scene_id%4=0 GROUP BY ALL), h AS (SELECT r, n, avg((s>=tau)::INT)<=0.06 AS h FROM m JOIN t USING (r, n) WHERE scene_id%4<>0 GROUP BY ALL) SELECT n::INT AS n, count(*) FILTER (h) AS chains, CASE WHEN n=10 THEN bool_and(h) ELSE count(*) FILTER (h)>=5 END AS holds FROM h GROUP BY n")
def verdict_transfer(spark, sf):
    """Whether a threshold set on the calibration scenes holds its level on the others, by size of the gallery."""
    sizes = spark.createDataFrame([(n,) for n in CE.SIZES], "n int")
    by = SE.similarities(V.query(spark, sf).filter("NOT known"), V.ref(spark, sf), ["scene_id", "vec_id"], per_label=True)
    m = cut(by.join(F.broadcast(V.chain(spark, sf)), "label_id").join(F.broadcast(sizes), F.col("pos") < F.col("n")).groupBy("r", "n", "scene_id", "vec_id").agg(F.max("s").alias("s")))
    t = F.broadcast(RK.quantiles_by(m.filter("scene_id % 4 = 0"), "s", ["r", "n"], {"tau": 0.95}))  # a row for each chain and size
    h = m.filter("scene_id % 4 <> 0").join(t, ["r", "n"]).groupBy("r", "n").agg(F.avg((F.col("s") >= F.col("tau")).cast("int")).alias("fpr"))
    return R.transfer(h.select("n", "r", R.eps_holds(F.col("fpr"), 0.05, 0.2).alias("holds")), CE.SIZES)


@query("verdict_rejection")
def verdict_rejection(spark, sf):
    """The outcome of the growth experiment at each error rate, from the verdicts of its rules."""
    v = CE.growth_rules_verdict(spark, sf).groupBy("eps").pivot("rule", ["model", "quantile_recal", "fixed"]).agg(F.first("majority"))
    v = v.select("eps", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("model", "quantile_recal", "fixed")))
    return v.withColumn("o", R.rejection_outcome(F.col("model"), F.col("quantile_recal"), F.col("fixed"))).select("eps", "model", "quantile_recal", "fixed", "o.refined", "o.as_written")


# ---- the selection before search -------------------------------------------------------------

_PER = "per AS (SELECT g.scene_id, count(*) AS den, count(*) FILTER (a.best>=0.5) AS every_, count(*) FILTER (r.best>=0.5) AS rho_, count(*) FILTER (x.best>=0.5) AS top_ FROM gt g JOIN ba a USING (scene_id, gt_no) JOIN br r USING (scene_id, gt_no) JOIN bx x USING (scene_id, gt_no) GROUP BY 1)"
_BEST = ", ".join(f"b{k} AS (SELECT g.scene_id, g.gt_no, coalesce(max(p.iou),0) AS best FROM gt g LEFT JOIN (SELECT p.* FROM p JOIN ({src}) USING (scene_id, mask_no)) p ON p.scene_id=g.scene_id AND p.gt_no=g.gt_no GROUP BY ALL)" for k, src in (("a", "SELECT scene_id, mask_no FROM pred"), ("r", "SELECT scene_id, mask_no FROM rho"), ("x", CR._RULES["maximal"])))
KEPT = f"{CS.RHO}, {V.GT}, {CS.PAIR}, {_BEST}, {_PER}, {V.boot_sql('gt')}"


def _sums(spark, sf, by=None):
    """(by, b, den, every, rho, top): ground truth of the replicates, and what of it all masks, the selected and the maximal ones find."""
    per = cut(N.found(V.gt(spark, sf), V.pred(spark, sf)))
    own = per.select("*", *(F.expr(c).alias(n) for n, c in (by or {}).items()))
    return S.weighted_sums(own, V.boot_vectors(per, 50), 50, ["den", "every", "rho", "top"], [*(by or {})])


_OUTCOMES = "v AS (SELECT b, {by}, sum(w*rho_)/sum(w*den)-sum(w*every_)/sum(w*den) AS value FROM per JOIN boot USING (scene_id) GROUP BY ALL), ci AS (SELECT {names}, round(quantile_cont(value,0.025),6) AS lo, round(quantile_cont(value,0.975),6) AS hi FROM v GROUP BY ALL), oc AS (SELECT *, CASE WHEN lo>0 THEN 1 WHEN hi<0 THEN 3 ELSE 2 END AS outcome FROM ci)"


def _outcomes(spark, sf, by):
    typed = [F.col(n).cast(t).alias(n) for n, (_, t) in by.items()]
    d = _sums(spark, sf, {n: c for n, (c, _) in by.items()}).select(*typed, (F.try_divide("rho", "den") - F.try_divide("every", "den")).alias("value"))
    return d.groupBy(*by).agg(*S.interval("value")).withColumn("outcome", R.outcome(F.col("lo"), F.col("hi")))


_LEVEL, _SPLIT = "scene_id % 3", "CASE WHEN scene_id % 4 = 0 THEN 'cal' ELSE 'test' END"


@query("verdict_outcomes", f"WITH RECURSIVE {KEPT}, {_OUTCOMES.format(by='scene_id%3 AS level', names='level')} SELECT * FROM oc")
def verdict_outcomes(spark, sf):
    """What the selection does to recall at each level of scenes: better, worse or undecided, by a paired interval."""
    return _outcomes(spark, sf, {"level": (_LEVEL, "long")})


@query("verdict_joint", f"WITH RECURSIVE {KEPT}, {_OUTCOMES.format(by='scene_id%3 AS level, ' + CR.SUBSET + ' AS split', names='level, split')} SELECT split, CASE WHEN count(DISTINCT outcome)=1 THEN max(outcome) END AS joint FROM oc GROUP BY 1")
def verdict_joint(spark, sf):
    """The outcome that all levels of a split share, if they do."""
    return R.joint(_outcomes(spark, sf, {"level": (_LEVEL, "long"), "split": (_SPLIT, "string")}), ["split"], "outcome")


@query("weak_variant", f"WITH RECURSIVE {KEPT}, v AS (SELECT b, sum(w*every_)/sum(w*den) AS e, sum(w*rho_)/sum(w*den) AS r, sum(w*top_)/sum(w*den) AS x FROM per JOIN boot USING (scene_id) GROUP BY b), l AS (SELECT round(quantile_cont(e-r,0.025),6) AS lo_rho, round(quantile_cont(e-x,0.025),6) AS lo_maximal FROM v) SELECT *, lo_rho>0 AND lo_maximal>0 AS weak FROM l")
def weak_variant(spark, sf):
    """Whether both selections fall behind all masks in recall: both paired intervals above zero."""
    less = lambda c: (F.try_divide("every", "den") - F.try_divide(c, "den")).alias(c)
    d = _sums(spark, sf).select(less("rho"), less("top"))
    both = d.agg(S.interval("rho")[0].alias("lo_rho"), S.interval("top")[0].alias("lo_maximal"))
    return both.withColumn("weak", (F.col("lo_rho") > 0) & (F.col("lo_maximal") > 0))


_ORDER = "CASE rule WHEN 'minimal' THEN 0 WHEN 'maximal' THEN 1 WHEN 'rho' THEN 2 ELSE 3 END"


@query("verdict_sequence", f"WITH RECURSIVE {CS.RHO}, {V.GT}, {CS.PAIR}, k AS ({' UNION ALL '.join(f'SELECT *, {n!r} AS rule FROM ({q})' for n, q in CR._RULES.items())}), f AS (SELECT rule, count(DISTINCT (p.scene_id, p.gt_no))/(SELECT count(*) FROM gt) AS recall FROM k JOIN p ON p.scene_id=k.scene_id AND p.mask_no=k.mask_no WHERE p.iou>=0.5 GROUP BY rule), o AS (SELECT rule AS name, recall, row_number() OVER (ORDER BY {_ORDER}) AS ord FROM f), st AS (SELECT name, recall, ord FROM o WHERE ord=1 UNION ALL SELECT CASE WHEN o.recall>=st.recall+0.01 THEN o.name ELSE st.name END, CASE WHEN o.recall>=st.recall+0.01 THEN o.recall ELSE st.recall END, o.ord FROM st JOIN o ON o.ord=st.ord+1) SELECT name, round(recall,9) AS recall FROM st ORDER BY ord DESC LIMIT 1")
def verdict_sequence(spark, sf):
    """Of the rules in order, the last that raises recall by a point over the one held so far."""
    n = V.gt(spark, sf).agg(F.count("*").alias("n"))
    order = F.when(F.col("rule") == "minimal", 0).when(F.col("rule") == "maximal", 1).when(F.col("rule") == "rho", 2).otherwise(3)
    rows = CR.rule_metrics(spark, sf).crossJoin(F.broadcast(n)).select(order.alias("ord"), F.col("rule").alias("name"), (F.col("found") / F.col("n")).alias("recall"))
    return R.sequential_choice(rows).select("name", F.round("recall", 9).alias("recall"))


@query("verdict_zones", f"WITH {CS.SCENE}, {CS.BEST}, z AS (SELECT scene_id%3 AS level, avg((best_iou>=0.5)::INT) AS upper, avg((best_iou>=0.75)::INT) AS lower, avg((best_iou>=0.65)::INT) AS found FROM best GROUP BY 1) SELECT level, round(found,9) AS found, CASE WHEN found>=upper-0.005 THEN 'upper' WHEN found<=lower+0.005 THEN 'lower' ELSE 'partial' END AS verdict FROM z")
def verdict_zones(spark, sf):
    """Where recall at IoU 0.65 lies between those at 0.5 and at 0.75, by level of scenes."""
    at = lambda t: F.avg((F.col("best_iou") >= t).cast("int"))
    z = B.best_per_gt(V.gt(spark, sf), V.pred(spark, sf)).groupBy(F.expr(_LEVEL).alias("level")).agg(at(0.5).alias("upper"), at(0.75).alias("lower"), at(0.65).alias("found"))
    return z.select("level", F.round("found", 9).alias("found"), R.zone_verdict(F.col("found"), F.col("upper"), F.col("lower"), 0.005).alias("verdict"))


# ---- the evaluation by category -----------------------------------------------------------------

_MATCHED = f"{CS.EVAL}, {CS.match_sql()}, {CS.ap_sql()}"


def _by_category(spark, sf):
    """cat, npig, aps: AP at each threshold."""
    m, g = CS._eval(spark, sf)
    return M.ap_by_threshold(m, M.gt_counts(g), ["cat"], bounds=M.score_bounds(V.pred(spark, sf)))


@query("verdict_first_run", f"WITH RECURSIVE {_MATCHED} SELECT cat, round(ap*100,6) AS ap, ap*100>=30 AND abs(ap*100-41.61)<=8 AS ok FROM mt_ap")
def verdict_first_run(spark, sf):
    """The first-run check on the AP of each category."""
    ap = _by_category(spark, sf).select("cat", (M.mean_of(F.col("aps")) * 100).alias("ap"))
    return ap.select("cat", F.round("ap", 6).alias("ap"), R.first_run(F.col("ap")).alias("ok"))


@query("best_variant", f"WITH RECURSIVE {_MATCHED}, h AS (SELECT cat, sum(p)/101 AS ap50 FROM (SELECT cat, x, max(prec) AS p FROM mt_pr JOIN points ON x<=recall WHERE thr=0 GROUP BY ALL) GROUP BY cat), v AS (SELECT cat::VARCHAR AS name, ap*100 AS ap, coalesce(ap50,0)*100 AS ap50, cat AS ord FROM mt_ap LEFT JOIN h USING (cat)) SELECT name, round(ap,6) AS ap, round(ap50,6) AS ap50, ord FROM v WHERE ap>=(SELECT max(ap) FROM v)-0.1 ORDER BY v.ap50 DESC, ord LIMIT 1")
def best_variant(spark, sf):
    """The best of the categories by AP, those within a tenth of a point by AP50."""
    v = _by_category(spark, sf).select(F.col("cat").cast("string").alias("name"), (M.mean_of(F.col("aps")) * 100).alias("ap"), (F.col("aps")[0] * 100).alias("ap50"), F.col("cat").alias("ord"))
    return R.best_variant(v).select("name", F.round("ap", 6).alias("ap"), F.round("ap50", 6).alias("ap50"), "ord")


_RECALL = f"rc AS (SELECT gt_label AS type, ({' + '.join(f'count(*) FILTER (best_iou>={float(t)!r}::DOUBLE)' for t in M.IOU_THRESHOLDS)})/10/count(*) AS recall FROM best GROUP BY 1)"


def _recall(spark, sf):
    hits = [F.count_if(F.col("best_iou") >= float(t)) for t in M.IOU_THRESHOLDS]
    b = B.best_per_gt(V.gt(spark, sf), V.pred(spark, sf)).groupBy(F.col("gt_label").alias("type")).agg(*(h.alias(f"h{i}") for i, h in enumerate(hits)), F.count("*").alias("n"))
    return b.select("type", (sum((F.col(f"h{i}") for i in range(1, len(hits))), F.col("h0")) / 10 / F.col("n")).alias("recall"))


@query("ap_ceiling", f"WITH {CS.SCENE}, {CS.BEST}, {_RECALL} SELECT type, round(recall,9) AS recall, round(least(1.0::DOUBLE, recall+1.0::DOUBLE/101),9) AS top FROM rc")
def ap_ceiling(spark, sf):
    """The highest AP that the recall of a category allows."""
    return _recall(spark, sf).select("type", F.round("recall", 9).alias("recall"), F.round(R.ap_ceiling(F.col("recall")), 9).alias("top"))


@query("verdict_ceiling", f"WITH RECURSIVE {_MATCHED}, {CS.PAIR}, {CS.BEST}, {_RECALL}, x AS (SELECT type, ap, least(1.0::DOUBLE, recall+1.0::DOUBLE/101) AS top FROM mt_ap JOIN rc ON rc.type=mt_ap.cat) SELECT type, round(ap,9) AS ap, round(top,9) AS top, ap>top+1e-12 AS violated FROM x")
def verdict_ceiling(spark, sf):
    """Whether the AP of a category is above what its recall allows: an error of the evaluation."""
    ap = _by_category(spark, sf).select(F.col("cat").alias("type"), M.mean_of(F.col("aps")).alias("ap"))
    return R.ceiling_check(ap, _recall(spark, sf)).select("type", F.round("ap", 9).alias("ap"), F.round("top", 9).alias("top"), "violated")


# ---- deduplication of the gallery ------------------------------------------------------------------

_SWEEP = f"""{CG.SIM}, e(e, eta) AS (VALUES {", ".join(f"({i},{x})" for i, x in enumerate(CR.ETAS))}), o AS MATERIALIZED (SELECT ref_id, label_id, insert_no, z, row_number() OVER (PARTITION BY label_id ORDER BY insert_no)-1 AS rank FROM ref),
items AS MATERIALIZED (SELECT label_id*10+e AS grp, rank FROM o, e), pr AS MATERIALIZED (SELECT m.label_id, m.rank, n.rank AS b, list_dot_product(m.z,n.z) AS s FROM o m JOIN o n ON m.label_id=n.label_id AND n.rank<m.rank),
sup AS MATERIALIZED (SELECT label_id*10+e AS grp, rank, list(b) AS before FROM pr JOIN e ON s>=eta GROUP BY ALL), {CS.FIT},
kp AS MATERIALIZED (SELECT e, eta::DOUBLE AS eta, o.ref_id FROM won JOIN e ON grp%10=e JOIN o ON o.label_id=grp//10 AND o.rank=won.rank UNION ALL SELECT -1, NULL, ref_id FROM ref),
dl AS (SELECT e, vec_id, known, label_id, max(s) AS s FROM sim JOIN kp USING (ref_id) GROUP BY ALL), dd AS (SELECT e, vec_id, known, arg_max(label_id, (s, -label_id)) AS y, max(s) AS s FROM dl GROUP BY ALL),
fu AS (SELECT vec_id, q.label_id AS truth, d.y, d.s FROM dd d JOIN query q USING (vec_id) WHERE e=-1 AND d.known),
dp AS (SELECT d.e, count(*) FILTER (f.y=f.truth AND d.y<>f.truth) AS lost, count(*) FILTER (f.y<>f.truth AND d.y=f.truth) AS won, count(*) AS n, avg(f.s-d.s) AS fall FROM dd d JOIN fu f USING (vec_id) WHERE d.e>=0 GROUP BY 1),
pt AS (SELECT eta, (SELECT count(*) FROM kp WHERE kp.e=dp.e) AS kept, lost, won, n, round(fall,9) AS fall FROM dp JOIN (SELECT DISTINCT e, eta FROM kp) USING (e))"""


def _points(spark, sf):
    """By threshold: rows kept, right answers lost and won, and how far the best similarity falls, on the known queries."""
    q, r = V.query(spark, sf).filter("known"), V.ref(spark, sf)
    p = cut(CG._rivals(spark, sf, min(CR.ETAS)))
    decided = lambda refs: SE.decide(SE.similarities(q, refs, ["vec_id"], per_label=True), q, ["vec_id"])
    full = cut(decided(r).join(q.select("vec_id", F.col("label_id").alias("truth")), "vec_id").select("vec_id", "truth", F.col("y_hat").alias("y0"), F.col("s_star").alias("s0")))
    out = None
    for eta in CR.ETAS:
        kept = cut(G.dedup(p, r, eta))
        x = decided(r.join(kept, ["label_id", "insert_no"], "left_semi")).join(full, "vec_id")
        was, now = F.col("y0") == F.col("truth"), F.col("y_hat") == F.col("truth")
        row = x.agg(F.count_if(was & ~now).alias("lost"), F.count_if(~was & now).alias("won"), F.count("*").alias("n"), F.round(F.avg(F.col("s0") - F.col("s_star")), 9).alias("fall"))
        row = row.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept")))).select(F.lit(eta).alias("eta"), "kept", "lost", "won", "n", "fall")
        out = row if out is None else out.unionByName(row)
    return out


@query("dedup_points", f"WITH RECURSIVE {_SWEEP} SELECT * FROM pt")
def dedup_points(spark, sf):
    return _points(spark, sf)


LOSS = 0.03  # share of the known queries that deduplication may cost


@query("dedup_eta_choice", f"WITH RECURSIVE {_SWEEP} SELECT min(eta) FILTER (lost<={LOSS}*n) AS eta, count(*) AS points FROM pt")
def dedup_eta_choice(spark, sf):
    """The smallest threshold that costs at most three in a hundred answers; null if all cost more."""
    return _points(spark, sf).agg(F.min(F.when(F.col("lost") <= LOSS * F.col("n"), F.col("eta"))).alias("eta"), F.count("*").alias("points"))
