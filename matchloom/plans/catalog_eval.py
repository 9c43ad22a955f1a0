"""Queries of whole evaluations, the growth experiment, and the decision rules that read their results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import boxes as B
from ..operators import calibration as C
from ..operators import composite as E
from ..operators import nesting as N
from ..operators import ranks as RK
from ..operators import rules as R
from ..operators import search as S
from ..operators.kernel import per_group
from . import catalog_gallery as CG
from . import catalog_scenes as CS
from . import views as V
from .cut import cut, stored
from .registry import query

ORACLE_REST = CS.ORACLE[len(CS.SCENE) + 2 :]
SUB = "sub AS (SELECT scene_id, unnest(['all/all', sp||'/all', 'all/'||lv, sp||'/'||lv]) AS subset FROM (SELECT DISTINCT scene_id, CASE WHEN scene_id%4=0 THEN 'cal' ELSE 'test' END AS sp, (scene_id%3)::VARCHAR AS lv FROM pred))"
AREA_NAME = "['small','medium','large'][({b})+1]"


def _of(spark, sf):
    s = V.pred(spark, sf).select("scene_id").distinct()
    return E.subsets(s.select("scene_id", F.when(F.col("scene_id") % 4 == 0, "cal").otherwise("test").alias("split"), (F.col("scene_id") % 3).cast("string").alias("level")))


def _precision_sql(src: str) -> tuple[str, str]:
    """CTEs, and the select of (subset, area, ...) of detections src."""
    ctes, out = [], []
    for n, lo, hi in CS.RANGES:
        m = f"e_{n}"
        ctes.append(CS.match_sql(m, lo=lo, hi=hi, max_det=1000, src=src))
        ctes.append(f"""{m}_sn AS (SELECT subset, cat, count(*) AS npig FROM {m}_g JOIN sub USING (scene_id) WHERE NOT skip GROUP BY ALL),
{m}_pr AS (SELECT subset, cat, thr, recall, max(prec) AS prec FROM (SELECT subset, m.cat, thr, sum(matched::INT) OVER w/npig AS recall, sum(matched::INT) OVER w/(count(*) OVER w+2.220446049250313e-16) AS prec FROM {m} m JOIN sub USING (scene_id) JOIN {m}_sn USING (subset, cat) WHERE NOT ignored WINDOW w AS (PARTITION BY subset, m.cat, thr ORDER BY score DESC, scene_id, rank ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
{m}_at AS (SELECT s.subset, s.cat, s.npig, t.thr, coalesce(a.ap, 0) AS ap FROM {m}_sn s CROSS JOIN thrs t LEFT JOIN (SELECT subset, cat, thr, sum(p)/101 AS ap FROM (SELECT subset, cat, thr, x, max(prec) AS p FROM {m}_pr JOIN points ON x<=recall GROUP BY ALL) GROUP BY ALL) a ON a.subset=s.subset AND a.cat=s.cat AND a.thr=t.thr)""")
        out.append(f"SELECT subset, '{n}' AS area, (sum(npig) FILTER (thr=0))::BIGINT AS n_gt, count(*) FILTER (thr=0) AS n_categories, round(avg(ap),9) AS ap, round(avg(ap) FILTER (thr=0),9) AS ap50, round(avg(ap) FILTER (thr=5),9) AS ap75 FROM {m}_at GROUP BY subset")
    return ", ".join(ctes), " UNION ALL ".join(out)


_ORACLE_CTE, _ORACLE_AP = _precision_sql("od")
_ALL_CTE, _ALL_AP = _precision_sql("pred")
ANSWERS = f"""kn AS (SELECT o.scene_id, {CS.ABIN} AS abin, (m.label_id=o.gt_label)::INT AS hit, true AS known, m.score AS s FROM oracle o JOIN pred m ON m.scene_id=o.scene_id AND m.mask_no=o.mask_no
 UNION ALL SELECT m.scene_id, {CS.ABIN.replace('gt_area', '((m.x1-m.x0)*(m.y1-m.y0))')}, NULL, false, m.score FROM pred m JOIN d USING (scene_id, mask_no)),
ka AS (SELECT subset, unnest(['all', {AREA_NAME.format(b='abin')}]) AS area, hit, known, s FROM kn JOIN sub USING (scene_id)),
kp AS (SELECT subset, area, s, count(*) FILTER (known) AS p, count(*) FILTER (NOT known) AS n FROM ka GROUP BY ALL),
ku AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subset, area ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS under FROM kp),
au AS (SELECT subset, area, round(CASE WHEN sum(p)*sum(n)>0 THEN sum(p*(under+n/2))/(sum(p)*sum(n)) END,9) AS auroc FROM ku GROUP BY ALL),
tp AS (SELECT subset, area, count(*) FILTER (known) AS n_oracle, round(avg(hit),9) AS top1, count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown FROM ka GROUP BY ALL)"""


@query("evaluate_oracle", f"WITH RECURSIVE {CS.EVAL}, {CS.PAIR}, {ORACLE_REST}, {CS.DIST}, {SUB}, od AS (SELECT m.* FROM pred m WHERE EXISTS (SELECT 1 FROM d WHERE d.scene_id=m.scene_id AND d.mask_no=m.mask_no) OR EXISTS (SELECT 1 FROM oracle o WHERE o.scene_id=m.scene_id AND o.mask_no=m.mask_no)), {_ORACLE_CTE}, {ANSWERS}, ap AS ({_ORACLE_AP}) SELECT * FROM ap FULL JOIN (SELECT * FROM tp JOIN au USING (subset, area)) USING (subset, area)")
def evaluate_oracle(spark, sf):
    """Oracle-mode evaluation: AP, AP50, AP75, top-1 and AUROC by subset and area."""
    return E.evaluate_oracle(V.pred(spark, sf), CS._truth(spark, sf)[1], _of(spark, sf), CS.RANGES)


@query("evaluate_baseline", f"WITH RECURSIVE {CS.EVAL}, {SUB}, {_ALL_CTE} {_ALL_AP}")
def evaluate_baseline(spark, sf):
    """All masks as detections: AP, AP50, AP75 by subset and area."""
    return E.evaluate_baseline(V.pred(spark, sf), CS._truth(spark, sf)[1], _of(spark, sf), CS.RANGES)


@query("evaluate_selected", f"WITH RECURSIVE {CS.RHO}, {CS.EVAL[len(V.PRED) + 2:]}, {SUB}, kd AS (SELECT m.* FROM pred m JOIN rho USING (scene_id, mask_no)), {_precision_sql('kd')[0]} {_precision_sql('kd')[1]}")
def evaluate_selected(spark, sf):
    """The masks of the selection before search as detections."""
    return E.evaluate_baseline(V.pred(spark, sf), CS._truth(spark, sf)[1], _of(spark, sf), CS.RANGES, E.selected)


def _ar(by_category: bool, least: float | None) -> tuple[str, str]:
    m = f"a_{int(by_category)}_{int(least is not None)}"
    rows = " UNION ALL ".join(
        f"SELECT s.subset, {by_category} AS use_cats, {'NULL' if least is None else least}::DOUBLE AS threshold, {k} AS max_det, round(avg(coalesce(t.tp,0)/s.npig/10),9) AS ar FROM {m}_sn s LEFT JOIN (SELECT subset, cat, count(*) AS tp FROM {m} JOIN sub USING (scene_id) WHERE matched AND NOT ignored AND rank<{k} GROUP BY ALL) t ON t.subset=s.subset AND t.cat=s.cat GROUP BY s.subset"
        for k in (1, 10, 100)
    )
    return f"{CS.match_sql(m, by_category=by_category, least=least or 0.0)}, {m}_sn AS (SELECT subset, cat, count(*) AS npig FROM {m}_g JOIN sub USING (scene_id) WHERE NOT skip GROUP BY ALL)", rows


_ARS = [_ar(c, t) for c in (False, True) for t in (None, 0.4)]


@query("recall_variants", f"WITH RECURSIVE {CS.EVAL}, {SUB}, {', '.join(a for a, _ in _ARS)} {' UNION ALL '.join(b for _, b in _ARS)}")
def recall_variants(spark, sf):
    """Average recall by subset in four variants: categories and a bound on the score, with and without."""
    return E.recall_variants(V.pred(spark, sf), CS._truth(spark, sf)[1], _of(spark, sf))


_HITS = ", ".join(f"count(*) FILTER (best_iou>={float(t)!r}::DOUBLE) AS h{i}" for i, t in enumerate(CS.M.IOU_THRESHOLDS))
_ALLH = "+".join(f"h{i}" for i in range(10))
_RS = {"recall_50": "h0", "recall_75": "h5", "recall_50_95": f"({_ALLH})/10"}


@query("recall_summary", f"WITH {CS.SCENE}, {CS.BEST}, {V.boot_sql('gt')}, {SUB}, x AS (SELECT subset, unnest(['all', {AREA_NAME.format(b=CS.ABIN)}]) AS area, scene_id, best_iou FROM best JOIN sub USING (scene_id)), s AS (SELECT subset, area, scene_id, count(*) AS n, {_HITS} FROM x GROUP BY ALL), rp AS (SELECT subset, area, sum(n)::BIGINT AS n_gt, {', '.join(f'round(sum({c})/sum(n),9) AS {k}' for k, c in _RS.items())} FROM s GROUP BY ALL), v AS (SELECT subset, area, b, {', '.join(f'sum(w*({c}))/sum(w*n) AS {k}' for k, c in _RS.items())} FROM s JOIN boot USING (scene_id) GROUP BY ALL), ci AS (SELECT subset, area, {', '.join(f'round(quantile_cont({k},{q}),6) AS {k}_{n}' for k in _RS for n, q in (('lo', 0.025), ('hi', 0.975)))} FROM v GROUP BY ALL) SELECT * FROM rp LEFT JOIN ci USING (subset, area)")
def recall_summary(spark, sf):
    """Recall of the masks by subset and area at three levels, with intervals over resampled scenes."""
    g, m = V.gt(spark, sf), V.pred(spark, sf)
    return E.recall_summary(B.best_per_gt(g, m), _of(spark, sf), V.boot(g))


PARTS = 8  # parts of the scores: each has a number for every subset, replicate and threshold


def paired_ap(spark, sf, replicates: int):
    """(subset, b, ap, ap50): AP of the selected masks less that of all masks, in the same replicates of each subset's scenes.

    A scene is read once for both choices, and a detection carries one vector of draws and the scene's subsets as bits, so one sorted run serves all.
    """
    m, of = V.pred(spark, sf).withColumnRenamed("mask_no", "det_no"), cut(_of(spark, sf))
    w, out = cut(V.boot_vectors(V.gt(spark, sf), replicates)), None

    def both(det, gt):
        return [*E.M.every_mask(det, gt)[0], *E.selected(det, gt)[0]], {}

    for scenes, number, n in E.numbers(of):
        rows = stored(E.M.judged(m, CS._truth(spark, sf)[1], scenes.join(w.hint("merge"), "scene_id"), choose=both, picks=2))
        x = E.M.judged_ap(rows, 2, n, E.M.score_bounds(rows.filter("rank >= 0"), PARTS), replicates)
        x = x.groupBy("at", "b").pivot("k", [0, 1]).agg(F.avg(E.M.mean_of(F.col("aps"))).alias("ap"), F.avg(F.get("aps", F.lit(0))).alias("ap50"))
        part = x.join(number, "at").select("subset", "b", (F.col("1_ap") - F.col("0_ap")).alias("ap"), (F.col("1_ap50") - F.col("0_ap50")).alias("ap50"))
        out = part if out is None else out.unionByName(part)
    return out


@query("paired_ap_diff")
def paired_ap_diff(spark, sf):
    """What the selection does to AP and AP50 in each subset: intervals of the paired difference, and the outcome."""
    d = cut(paired_ap(spark, sf, 50)).selectExpr("subset", "stack(2, 'ap', ap, 'ap50', ap50) AS (metric, value)")
    ends = [F.round(F.percentile("value", F.lit(q)), 6).alias(n) for n, q in (("lo", 0.025), ("hi", 0.975))]
    return d.groupBy("subset", "metric").agg(F.count("*").alias("replicates"), *ends).withColumn("outcome", R.outcome(F.col("lo"), F.col("hi")))


# ---- growth of the gallery: five rules, two error rates ------------------------------------

SIZES, LEVELS, FIXED, TOP = (3, 5, 10), (0.05, 0.01), 0.35, 3
PAIRS = [(a, b) for a in SIZES for b in SIZES if b >= a]


SCENES_AT_ONCE = 64  # scenes whose answers one group holds


def _answers(met, members, labels):
    """(k, known, inside, correct, s, rank): what each query's best labels of every set k say, from the rows of ``Pairs.best``, merged by query; ranks are within a set and scene."""
    table = np.zeros((len(labels) + 1, len(members)), bool)
    for k, m in enumerate(members):
        table[m, k] = True
    keys = ["scene_id", "mask_no", "vec_id", "known", "truth", "times"]

    def solve(x):
        o = np.lexsort([x[c] for c in reversed(keys)])
        who = np.stack([x[c][o].astype(np.int64) for c in keys])
        head = np.flatnonzero(np.concatenate([[True], (who[:, 1:] != who[:, :-1]).any(axis=0)]))
        times = who[5, head]
        best = np.repeat(np.maximum.reduceat(np.frombuffer(b"".join(x["m"][o])).reshape(-1, len(labels)), head, axis=0), times, axis=0)
        scene, _, _, known, truth, _ = np.repeat(who[:, head], times, axis=1)
        place = np.minimum(np.searchsorted(labels, truth), len(labels) - 1)
        inside = table[np.where(labels[place] == truth, place, len(labels))]
        first = np.searchsorted(scene, scene)
        out = []
        for k, m in enumerate(members):
            v = best[:, m]
            s, y = v.max(axis=1), labels[m][v.argmax(axis=1)]  # labels rise: the smaller one on ties
            rank = np.empty(len(s), np.int64)
            by = np.lexsort((-s, scene))  # stable, so by mask_no on ties
            rank[by] = np.arange(len(s)) - first[by] + 1
            live = s > -np.inf
            out.append([c[live] for c in (np.full(len(s), k), known == 1, inside[:, k], y == truth, s, rank)])
        return dict(zip(("k", "known", "inside", "correct", "s", "rank"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True))

    group = met.withColumn("grp", F.floor(F.col("scene_id") / SCENES_AT_ONCE))
    return per_group(group, "grp", solve, "k int, known boolean, inside boolean, correct boolean, s double, rank int")


def _growth(spark, sf):
    """(r, n0, n, eps, rule, tau, fpr, miss, correct): rules at size n with what was calibrated at n0; tau null where there is none."""
    chain = V.chain(spark, sf).filter(F.col("pos") < max(SIZES)).collect()  # a few labels of each chain
    rows = {(r, n): {c["label_id"] for c in chain if c["r"] == r and c["pos"] < n and c["label_id"] is not None} for r in {c["r"] for c in chain} for n in SIZES}
    rows = {k: sorted(v) for k, v in sorted(rows.items()) if v}
    labels = np.array(sorted({x for v in rows.values() for x in v}), np.int64)
    refs = V.ref(spark, sf)
    size = {r["label_id"]: r["c"] for r in refs.filter(F.col("label_id").isin(labels.tolist())).groupBy("label_id").agg(F.count("*").alias("c")).collect()}
    many = {k: sum(size.get(x, 0) for x in v) for k, v in rows.items()}
    own = ["scene_id", "mask_no", "vec_id", "known", "truth"]
    asking = V.query(spark, sf).withColumn("truth", F.coalesce(F.col("label_id").cast("long"), F.lit(-(1 << 63))))
    asking = asking.groupBy(*own, "z").agg(F.count("*").alias("times"))  # repeated rows are answered each
    sets, index = list(rows), {k: i for i, k in enumerate(rows)}
    ans = stored(_answers(S.Pairs(asking, refs, [*own, "times"]).best(labels.tolist()), [np.searchsorted(labels, v) for v in rows.values()], labels))
    share = [*(1 - e for e in LEVELS), 0.5]
    found = RK.Ranks(RK.column(ans.filter("NOT known"), "s", "k"), groups=len(sets)).quantiles(np.repeat(np.arange(len(sets)), len(share)), np.tile(share, len(sets))).reshape(len(sets), -1)
    sets = [k for k in sets if not np.isnan(found[index[k], 0])]
    tau = {(*k, e): float(found[index[k], i]) for k in sets for i, e in enumerate(LEVELS)}
    # the model: tails of all row sets at once. A group of pairs for each label; a row set is a union of labels, so one pass over the pairs serves
    # all sets. Its thresholds lie from a set's quantile on, and half of the queries have a pair from the median of their best on: below it nothing is asked for
    number = {k: i for i, k in enumerate(sets)}
    floor = min((float(found[index[k], -1]) for k in sets), default=None)
    ranks = RK.Ranks(RK.pairs(V.query(spark, sf).filter("NOT known"), refs, by=lambda own, r: r.label_id[None, :], floor=floor), {i: rows[k] for k, i in number.items()})
    done = C.kappas(ranks, {(i, e): tau[(*k, e)] for k, i in number.items() for e in LEVELS}, {i: many[k] for k, i in number.items()})
    asked = [(k, e, n) for k in sets for e in LEVELS for n in SIZES if n >= k[1] and not done[number[k], e]["out_of_range"]]
    found = C.thresholds(ranks, [(number[k], e, done[number[k], e]["kappa"], many[k[0], n]) for k, e, n in asked])
    model = {(*k, e, n): t for (k, e, n), t in zip(asked, found, strict=True)}
    plan = []
    for r in sorted({k[0] for k in sets}):
        for n0, n in PAIRS:
            for e in LEVELS:
                plan += [(index[r, n], r, n0, n, e, *x) for x in (("quantile_recal", tau.get((r, n, e))), ("quantile_frozen", tau.get((r, n0, e))), ("model", model.get((r, n0, e, n))), ("fixed", FIXED), ("top_k", None))]
    cells = F.broadcast(spark.createDataFrame(plan, "k int, r long, n0 int, n int, eps double, rule string, tau double"))
    said = F.when(F.col("rule") == "top_k", F.col("rank") <= TOP).otherwise(F.col("s") >= F.col("tau"))
    x = ans.join(cells, "k").withColumn("said", said)
    rate = lambda cond, of: F.round(F.try_divide(F.count_if(cond), F.count_if(of & F.col("said").isNotNull())), 9)
    k = F.col("known") & F.col("inside")
    out = x.groupBy("r", "n0", "n", "eps", "rule").agg(F.first("tau").alias("tau"), rate(~F.col("known") & F.col("said"), ~F.col("known")).alias("fpr"), rate(k & ~F.col("said"), k).alias("miss"), rate(k & F.col("said") & F.col("correct"), k).alias("correct"), rate(F.col("known") & ~F.col("inside") & F.col("said"), F.col("known") & ~F.col("inside")).alias("unseen_answered"))
    return out.withColumn("predicted_ratio", F.when(F.col("rule") == "quantile_frozen", F.element_at(F.create_map(*(F.lit(v) for (r, n0, n, e) in {p[1:5] for p in plan} for v in (f"{r}/{n0}/{n}/{e}", float(-np.expm1(np.log1p(-e) * many[(r, n)] / many[(r, n0)]) / e)))), F.concat_ws("/", "r", "n0", "n", "eps"))))


@query("growth_rules")
def growth_rules(spark, sf):
    """The growth experiment: chains x growth x error rates x five rules (recalibrated and frozen quantile, model, fixed threshold, top k)."""
    return _growth(spark, sf)


@query("growth_rules_verdict")
def growth_rules_verdict(spark, sf):
    """Which rules hold the error rate on a majority of chains, over all growth pairs of a chain; a rule without a threshold holds nothing."""
    c = _growth(spark, sf).filter("n > n0")
    cells = c.select("eps", "rule", "r", F.concat_ws("->", "n0", "n").alias("pair"), F.coalesce(F.col("fpr") <= F.col("eps") * 1.2, F.lit(False)).alias("holds"))
    return R.majority(R.chain_verdict(cells, ["eps", "rule"]), ["eps", "rule"])


_CHOICE = "SELECT subset, ap, row_number() OVER (ORDER BY ap DESC, subset) AS place FROM e WHERE area='all'"


@query("verdict_subsets", f"WITH RECURSIVE {CS.EVAL}, {SUB}, {_ALL_CTE}, e AS ({_ALL_AP}), c AS ({_CHOICE}) SELECT c.subset, ap*100>=30 AND abs(ap*100-41.61)<=8 AS first_run, round(least(1.0::DOUBLE, ap+1.0/101),9) AS ceiling, place::INT AS place FROM c")
def verdict_subsets(spark, sf):
    """Decision rules on the evaluation's own results: the first-run check, the ceiling of AP, and the order of subsets."""
    e = evaluate_baseline(spark, sf).filter("area = 'all'")
    place = F.row_number().over(Window.orderBy(F.desc("ap"), "subset"))  # a row for each subset
    return e.select("subset", R.first_run(F.col("ap") * 100).alias("first_run"), F.round(R.ap_ceiling(F.col("ap")), 9).alias("ceiling"), place.alias("place"))
