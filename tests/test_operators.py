"""Hand-made cases and properties of the core operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions import scalar as X
from matchloom.operators import boxes as B
from matchloom.operators import calibration as C
from matchloom.operators import greedy as G
from matchloom.operators import metrics as M
from matchloom.operators import nesting as N
from matchloom.operators import ranks as RK
from matchloom.operators import rules as R
from matchloom.operators import search as S
from matchloom.sources import gallery as GA
from matchloom.sources import voc

MASK = "scene_id long, mask_no long, x0 double, y0 double, x1 double, y1 double, label_id int, score double"
GT = "scene_id long, gt_no long, gt_label int, x0 double, y0 double, x1 double, y1 double"


def masks(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, r[:4]), 0, float(r[4]) if len(r) > 4 else 0.5) for i, r in enumerate(rows)], MASK)


def test_decide_ties_deleted_and_threshold(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, z array<float>")
    r = spark.createDataFrame([(1, 5, 1, [1.0, 0.0]), (2, 3, 2, [1.0, 0.0])], "ref_id long, label_id int, insert_no long, z array<float>")
    d = {x.vec_id: x for x in S.decide(S.similarities(q, r, ["vec_id"], True), q, ["vec_id"], 0.5).collect()}
    assert (d[1].y_hat, d[1].s_star) == (3, 1.0)
    assert d[2].y_hat == -1
    none = S.decide(S.similarities(q, r.filter("ref_id < 0"), ["vec_id"], True), q, ["vec_id"]).collect()
    assert [x.y_hat for x in none] == [-1, -1]


def test_rho_cases(spark):
    # equal areas are not nested; a near-duplicate chain leaves its smallest; a part inside a whole goes with its container kept apart
    same = masks(spark, [(0, 0, 10, 10), (0, 0, 10, 10)])
    assert N.select(same).count() == 2
    chain = masks(spark, [(0, 0, 100, 100), (0, 0, 100, 92), (0, 0, 100, 85)])
    assert [r.mask_no for r in N.select(chain).collect()] == [2]
    part = masks(spark, [(0, 0, 100, 100), (0, 0, 20, 20)])
    assert [r.mask_no for r in N.select(part).collect()] == [0]
    assert N.violations(N.select(part), N.nested(part)).count() == 0


def test_nms_threshold_is_strict_and_idempotent(spark, sf):
    m = masks(spark, [(0, 0, 10, 10, 0.9), (0, 0, 10, 5, 0.8)])  # IoU exactly 0.5
    assert G.box_nms(m, 0.5).count() == 2
    assert [r.mask_no for r in G.box_nms(m, 0.49).collect()] == [0]
    from matchloom.plans import views as V

    p = V.pred(spark, sf).filter("scene_id < 5")
    once = p.join(G.box_nms(p), ["scene_id", "mask_no"], "left_semi")
    assert G.box_nms(once).count() == once.count()


def test_rounds_equal_groups(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(int(g), int(r)) for g in range(3) for r in range(40)], "grp long, rank long")
    e = sorted({(int(g), int(max(a, b)), int(min(a, b))) for g, a, b in rng.integers(0, [3, 40, 40], (150, 3)) if a != b})
    c = spark.createDataFrame(e, "grp long, rank long, before long")
    key = lambda d: {(r.grp, r.rank) for r in d.collect()}
    assert key(G.first_fit_rounds(items, c)) == key(G.first_fit(items, c))


def test_oracle_ties_and_misses(spark):
    g = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0, 50.0, 50.0, 60.0, 60.0)], GT)
    m = masks(spark, [(0, 0, 10, 10), (0, 0, 10, 10)])
    assert {(r.gt_no, r.mask_no) for r in G.oracle_assign(g, m).collect()} == {(0, 0), (1, -1)}


def test_distractors_without_ground_truth(spark):
    m = masks(spark, [(0, 0, 10, 10), (20, 20, 30, 30)])
    none = spark.createDataFrame([], GT)
    assert B.distractors(none, m).count() == 2
    z = spark.createDataFrame([(0, 5.0, 5.0, 6.0, 6.0)], "scene_id long, x0 double, y0 double, x1 double, y1 double")
    assert [r.mask_no for r in B.distractors(none, m, z).collect()] == [1]


def test_area_on_an_edge(spark):
    d = spark.createDataFrame([(1024.0,), (1023.0,), (2048.0,)], "a double")
    assert [r[0] for r in d.select(B.area_bin(F.col("a"))).collect()] == [1, 0, 2]


def cols(rows, names):
    return {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}


DET, G_ = ("det_no", "score", "x0", "y0", "x1", "y1"), ("gt_no", "iscrowd", "x0", "y0", "x1", "y1")


def test_matching_rules():
    gt = cols([(0, False, 0, 0, 10, 10), (1, True, 0, 20, 40, 60)], G_)
    det = cols([(0, 0.9, 0, 0, 10, 10), (1, 0.8, 0, 0, 10, 10), (2, 0.7, 0, 20, 10, 30), (3, 0.6, 5, 25, 15, 35)], DET)
    r = pd.DataFrame(M.match_group(det, gt, np.array([0.5]), 0, 1e10, 100))
    assert r["matched"].tolist() == [True, False, True, True]  # the crowd matches again and again
    assert r["ignored"].tolist() == [False, False, True, True]
    small = pd.DataFrame(M.match_group(det, gt, np.array([0.5]), 1e5, 1e10, 100))
    assert small["ignored"].all()  # out of range


def test_ap_by_hand_and_by_brute_force(spark):
    g = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 10.0, 10.0, False), (1, 0, 0, 0.0, 0.0, 10.0, 10.0, False), (1, 1, 1, 0.0, 0.0, 9.0, 9.0, False)], GT + ", iscrowd boolean")
    d = spark.createDataFrame([(0, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 0, 0.8, 50.0, 50.0, 60.0, 60.0), (1, 1, 0, 0.7, 0.0, 0.0, 10.0, 10.0)], "scene_id long, det_no long, label_id int, score double, x0 double, y0 double, x1 double, y1 double")
    ap = {r.cat: r.ap for r in M.average_precision(M.packed(d, g), M.gt_counts(g)).collect()}
    tp, fp = np.array([1, 1, 2]), np.array([0, 1, 1])
    rc, pr = tp / 2, tp / (tp + fp + np.spacing(1))
    env = np.maximum.accumulate(pr[::-1])[::-1]
    at = np.searchsorted(rc, M.RECALL_POINTS, "left")
    assert ap[0] == pytest.approx(np.mean([env[i] if i < 3 else 0 for i in at]), abs=1e-12)
    assert ap[1] == 0.0


def test_auroc(spark):
    d = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)], "positive boolean, s double")
    assert M.auroc(d).collect()[0][0] == pytest.approx(0.875)
    assert M.auroc(d.withColumn("s", -F.col("s"))).collect()[0][0] == pytest.approx(0.125)
    assert M.auroc(d.filter("positive")).collect()[0][0] is None


def test_calibration_scalars(spark):
    assert C.place(0.05, 0.5, 10, 101) == pytest.approx(100 * 0.95 ** (1 / 5)) and C.kappa_for(0.05, C.place(0.05, 0.5, 10, 101), 10, 101) == pytest.approx(0.5)
    n = spark.createDataFrame([(6, 100), (7, 100)], "k long, n long")
    assert [r[0] for r in n.select(C.needs_recalibration(F.col("k"), F.col("n"), (1, 20), (1, 5))).collect()] == [False, True]


def test_gallery_append_rejects(spark):
    g = spark.createDataFrame([(1, 0, 0, False, [1.0, 0.0])], "ref_id long, label_id int, insert_no long, deleted boolean, z array<float>")
    row = lambda i, z: spark.createDataFrame([(i, 0, z)], "ref_id long, label_id int, z array<float>")
    assert GA.append(g, row(2, [0.0, 1.0]), 2).count() == 2
    for bad in (row(1, [0.0, 1.0]), row(3, [1.0]), row(4, [float("nan"), 0.0])):
        with pytest.raises(Exception):  # noqa: B017
            GA.append(g, bad, 2).collect()


def test_rle_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (7, 5), (40, 33)):
        m = rng.random(shape) < 0.4
        r = X.rle_encode(m)
        assert (X.rle_decode(r) == m).all() and X.rle_area(r) == m.sum()


def test_width_of_a_chain_and_an_antichain():
    assert N.matching_width(3, [(0, 1), (1, 2)]) == 1
    assert N.matching_width(4, [(0, 3), (1, 3)]) == 3


def test_voc_rules(spark):
    d = spark.createDataFrame([("a",), ("b2",), ("junk",)], "name string")
    out = voc.with_rules(d, {"b2": "b"}, ["junk"], ["a", "b"]).collect()
    assert {(r.name, r.category_id) for r in out} == {("a", 0), ("b", 1)}
    with pytest.raises(Exception):  # noqa: B017
        voc.with_rules(d, {}, [], ["a"]).collect()


def test_zone_verdict(spark):
    d = spark.createDataFrame([(60.0, 50.0, 59.0), (60.0, 50.0, 51.0), (60.0, 50.0, 55.0), (60.0, 50.0, None)], "hi double, lo double, d double")
    got = [r[0] for r in d.select(R.zone_verdict(F.col("d"), F.col("hi"), F.col("lo"), 1.0)).collect()]
    assert got == ["upper", "lower", "partial", None]
    with pytest.raises(Exception, match="overlap"):
        d.select(R.zone_verdict(F.col("d"), F.lit(52.0), F.col("lo"), 1.0)).collect()


def test_transfer_wants_one_full_cell(spark):
    c = spark.range(9).selectExpr("100 n", "id r", "id > 0 holds")
    with pytest.raises(Exception, match="differ"):
        R.transfer(c).collect()
    assert R.transfer(c.withColumn("holds", F.lit(False))).collect()[0].holds is False
    assert R.transfer(c.withColumn("n", F.lit(25))).collect()[0].holds is True


def test_sequential_choice(spark):
    rows = lambda *r: spark.createDataFrame([(i, n, float(x)) for i, (n, x) in enumerate(r)], "ord int, name string, recall double")
    assert R.sequential_choice(rows(("a", 0.5), ("b", 0.505), ("c", 0.6), ("d", 0.605))).collect()[0].name == "c"
    assert R.sequential_choice(rows(("a", 0.5))).collect()[0].name == "a"
    assert R.sequential_choice(rows(("a", 0.5)).limit(0)).count() == 0


def test_matching_ignores_zones_and_frees_crowds():
    box = lambda *rows: {c: np.array([r[i] for r in rows], dtype=float) for i, c in enumerate(("x0", "y0", "x1", "y1"))}
    det = {**box((0, 0, 10, 10), (0, 0, 10, 10), (0, 0, 10, 10)), "det_no": np.arange(3), "score": np.array([0.9, 0.8, 0.7])}
    gt = {**box((0, 0, 10, 10), (0, 0, 40, 40)), "gt_no": np.array([0, 1]), "iscrowd": np.array([False, True])}
    m = M.match_group(det, gt, np.array([0.5]), 0.0, 1e10, 100)
    # the first takes the box, the others the crowd, again and again, and count for nothing
    assert m["gt_no"].tolist() == [0, 1, 1] and m["ignored"].tolist() == [False, True, True]


def plain_threshold(pairs, eps, kappa, refs):
    return float(np.quantile(pairs, math.exp(math.log1p(-eps) / (kappa * refs))))


def test_kappa_meets_the_quantile_threshold(spark):
    """The closed form against bisection on the quantile of all pairs; plateaus, levels out of reach."""
    rng = np.random.default_rng(1)
    pairs = np.sort(np.concatenate([rng.normal(size=5000), np.repeat(2.7, 40), np.repeat(-9.0, 30)]))
    ranks = RK.Ranks(RK.column(spark.createDataFrame([(float(x),) for x in pairs], "x double"), "x"))
    levels = [2.2, 2.6, 2.7, 3.0, float(pairs[-1]), float(pairs[-1]) + 1, -9.0, -20.0, 0.0, float(pairs[4000])]
    for eps, refs in ((0.05, 60), (0.01, 3), (0.3, 2)):
        for level in levels:
            got = C.calibrate(ranks, {(0, eps): level}, {0: refs})[0, eps]
            ends = [plain_threshold(pairs, eps, k, refs) for k in C.KAPPA]
            assert got["out_of_range"] == (not ends[0] <= level <= ends[1]), (eps, refs, level, ends, got)
            if not got["out_of_range"]:
                lo, hi = (math.log(k) for k in C.KAPPA)
                while hi - lo > 1e-12:
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if plain_threshold(pairs, eps, math.exp(mid), refs) < level - 1e-12 else (lo, mid)
                assert got["kappa"] == pytest.approx(math.exp(hi), rel=1e-6) and got["tau_m"] == pytest.approx(level, abs=1e-9)
    assert C.solve(0.05, 1.0, 5, 0, (0, 0, -math.inf, math.inf)) is None
    with pytest.raises(ValueError):
        C.tail_record(RK.Ranks(RK.column(spark.createDataFrame([], "x double"), "x")))


def vectors(spark, rows, names="ref_id long, label_id int, insert_no long, z array<float>"):
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def pool(spark):
    """Queries and references with repeats, null vectors, null components and another length."""
    rng = np.random.default_rng(7)
    z = rng.normal(size=(60, 6)).astype(np.float32).round(2)
    refs = [(i, i % 5, i * 3, z[i].tolist()) for i in range(50)] + [(50, 1, 150, None), (51, 2, 153, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (52, 3, 156, [1.0]), (53, 0, 159, z[3].tolist())]
    queries = [(i, z[50 + i].tolist()) for i in range(10)] + [(3, z[53].tolist()), (3, z[53].tolist()), (90, None), (91, [float("nan")] * 6)]
    return z, vectors(spark, refs), spark.createDataFrame(queries, "q long, z array<float>")


@pytest.mark.parametrize("limit", [64 << 20, 400])
def test_search_against_brute_force(spark, monkeypatch, pool, limit):
    """Broadcast and grid alike: all pairs, best of labels, nearest, counts, quantiles; repeated queries are answered each."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(S, "QUERY_ROWS", 3)
    z, refs, queries = pool
    ids = [*range(50), 53]
    x = z.astype(float)[[*range(50), 3]]
    rows = [*range(10), 3, 3]
    s = z.astype(float)[[50 + i for i in rows]] @ x.T
    key = lambda d: sorted((r.q, r.ref_id, round(r.s, 9)) for r in d.collect())
    assert key(S.similarities(queries, refs, ["q"])) == sorted((q, ids[j], round(float(s[i, j]), 9)) for i, q in enumerate(rows) for j in range(51))
    best = sorted((r.q, r.label_id, round(r.s, 9)) for r in S.similarities(queries, refs, ["q"], per_label=True).collect())
    assert best == sorted((q, y, round(float(max(s[i, j] for j in range(51) if (ids[j] % 5 if j < 50 else 0) == y)), 9)) for i, q in enumerate(rows) for y in range(5))
    near = sorted((r.q, r.rank, r.ref_id) for r in S.nearest(queries, refs, ["q"], 4).collect())
    assert near == sorted((q, k + 1, ids[j]) for i, q in enumerate(rows) for k, j in enumerate(sorted(range(51), key=lambda j: (-s[i, j], ids[j]))[:4]))
    assert S.shares(queries, refs, [(0.5, None), (0.5, lambda r: r.insert_no > 60)]) == [(s.size, int((s >= 0.5).sum())), (30 * len(rows), int((s[:, 21:] >= 0.5).sum()))]
    d = RK.Ranks(RK.pairs(queries, refs))
    assert d.n == {0: s.size} and sorted(r.s for r in RK.top(queries, refs, 40).collect()) == pytest.approx(np.sort(s.ravel())[-40:].tolist())
    assert RK.top(queries, refs, 10**6).count() == s.size
    assert np.allclose(d.quantiles(np.zeros(33, int), np.linspace(0, 1, 33)), np.quantile(s, np.linspace(0, 1, 33)))
    assert np.allclose([r.value for r in d.quantile_frame(np.linspace(0, 1, 33)).orderBy("i").collect()], np.quantile(s, np.linspace(0, 1, 33)))
    by = lambda own, r: np.where(r.label_id == 2, -1, own.column(0).to_numpy()[:, None] % 2)
    two = RK.Ranks(RK.pairs(queries, refs, ["q"], by), {0: [1], 1: [0, 1], 2: [7]})
    some = [j for j in range(51) if (ids[j] % 5 if j < 50 else 0) != 2]
    odd, both = s[[i for i, q in enumerate(rows) if q % 2]][:, some], s[:, some]
    assert two.n == {0: odd.size, 1: both.size, 2: 0}
    assert np.allclose(two.quantiles(np.array([0, 1, 0, 1]), np.array([0.1, 0.5, 0.5, 1.0])), [np.quantile(odd, 0.1), np.quantile(both, 0.5), np.quantile(odd, 0.5), both.max()])
    assert np.isnan(two.quantiles(np.array([2]), np.array([0.5]))).all()
    near = two.around(np.array([0.5, 99.0]))
    assert near[0, 0] == (int((odd < 0.5).sum()), int((odd == 0.5).sum()), pytest.approx(odd[odd < 0.5].max()), pytest.approx(odd[odd >= 0.5].min())) and near[1, 1][:2] == (both.size, 0)
    none = S.decide(S.similarities(queries, refs, ["q"], per_label=True), queries, ["q"]).filter("q >= 90").collect()
    assert [(r.y_hat, r.s_star) for r in none] == [(-1, None), (-1, None)]
    assert S.similarities(queries, refs.limit(0), ["q"]).count() == 0 and RK.Ranks(RK.pairs(queries, refs.limit(0))).n == {0: 0}


@pytest.mark.parametrize("held", [(1 << 20, 1 << 24), (20, 100)])
def test_ranks_of_pairs_by_bins(spark, monkeypatch, held):
    """Many cells from rows of one partition, each counting once; bins that must be split, equal vectors, numbers far apart, products that are not finite."""
    monkeypatch.setattr(RK, "NODE_ROWS", held[0])
    monkeypatch.setattr(RK, "LAST_ROWS", held[1])
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 4 * 100)
    monkeypatch.setattr(S, "CELL_QUERIES", 128)
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(400, 4)), rng.normal(size=(300, 4))
    a[:200], b[:150], a[200], b[200] = a[0], b[0], 0.0, 1e-9
    b[299] = a[399] = 1e200
    frame = lambda z, id_: spark.createDataFrame([(i, i % 3, i, x.tolist()) for i, x in enumerate(z)], f"{id_} long, label_id int, insert_no long, z array<double>").coalesce(1)
    for n, wild in ((-1, False), (None, True)):
        x, y = a[:n], b[:n]
        with np.errstate(over="ignore"):
            s = (x @ y.T).ravel()
        s = np.sort(s[np.isfinite(s)])
        source = RK.pairs(frame(x, "q"), frame(y, "ref_id"))
        assert source.pairs.wild == wild and source.pairs.blocks >= 3 and source.pairs.parts >= 4
        bins = RK.Bins(source.pairs, None, np.zeros(1, int))
        passed = source.pairs.gather(lambda: RK._Histogram(bins), RK.COUNTS).groupBy("slot", "digit").count()  # noqa: B023
        assert passed.agg({"count": "max"}).collect()[0][0] <= source.pairs.blocks * source.pairs.parts
        d = RK.Ranks(source)
        assert d.n == {0: len(s)}
        ranks = np.unique(np.concatenate([np.arange(0, len(s), 997), [0, 1, len(s) - 2, len(s) - 1]]))
        assert np.allclose(d.values(np.zeros(len(ranks), int), ranks), s[ranks], rtol=1e-12, atol=1e-15)
        levels = np.array([-50.0, 0.0, 0.3, 1e201])
        for i, level in enumerate(levels):
            below, equal, under, over = d.around(levels)[0, i]
            assert (below, equal) == (int((s < level).sum()), int((s == level).sum()))
            assert under == pytest.approx(max(s[s < level], default=-np.inf)) and over == pytest.approx(min(s[s >= level], default=np.inf))
        top = np.sort([r.s for r in RK.top(frame(x, "q"), frame(y, "ref_id"), 31_000).collect()])
        assert np.allclose(top, s[-31_000:], rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("rows_at_once", [4096, 7])
def test_products_within_labels(spark, monkeypatch, rows_at_once):
    """A label with most rows, in blocks too; rows without label or sound vector; work is by label."""
    monkeypatch.setattr(S, "LABEL_ROWS", rows_at_once)
    rng = np.random.default_rng(4)
    z = rng.normal(size=(70, 5)).astype(np.float32)
    label = [1 if i < 50 else i % 6 + 2 for i in range(70)]
    refs = vectors(spark, [(i, label[i], 70 - i, z[i].tolist()) for i in range(70)] + [(90, None, 90, z[0].tolist()), (91, 1, 91, None), (92, 1, 92, [1.0, None, 1.0, 1.0, 1.0])])
    s = z.astype(float) @ z.astype(float).T
    met = []
    plain = S.fold_within
    monkeypatch.setattr(S, "fold_within", lambda r, fold, names: met.append(1) or plain(r, fold, names))
    earlier = lambda own, r: r.insert_no < own.column(2).to_numpy()[:, None]
    got = sorted((r.own, r.ref_id, round(r.s, 9)) for r in S.similarities_within(refs, 0.2, earlier).collect())
    assert got == sorted((i, j, round(float(s[i, j]), 9)) for i in range(70) for j in range(70) if label[i] == label[j] and 70 - j < 70 - i and s[i, j] >= 0.2)
    other = lambda own, r: own.column(0).to_numpy()[:, None] != r.ref_id
    near = {r.own: (r.ref_id, r.s) for r in S.nearest_within(refs, other).collect()}
    for i in range(70):
        mine = [(s[i, j], -j) for j in range(70) if j != i and label[j] == label[i]]
        assert near[i] == (-max(mine)[1], pytest.approx(max(mine)[0])) if mine else i not in near
    assert S.similarities_within(refs.limit(0), 0.2, earlier).count() == 0 and len(met) == 3


def test_decide_compares_unrounded(spark):
    refs = vectors(spark, [(1, 1, 1, [1.0, 0.0]), (2, 2, 2, [1.0, 3e-7])])
    q = spark.createDataFrame([(0, [1.0, 1.0])], "q long, z array<float>")
    got = lambda **k: S.decide(S.similarities(q, refs, ["q"], per_label=True, **k), q, ["q"]).collect()[0].y_hat
    assert got() == 2 and got(places=6) == 1


def test_lsh_grows_with_the_gallery(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(3000, 16))
    refs = vectors(spark, [(i, i % 7, i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(z)])
    near = z[:100] + 0.35 * rng.normal(size=(100, 16))
    q = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(near)], "q long, z array<float>")
    got = {r.q: r for r in S.lsh_search(q, refs, ["q"], 16).collect()}
    exact = {r.q: r for r in S.nearest(q, refs, ["q"], 1).collect()}
    assert np.mean([q_ in got and got[q_].ref_id == r.ref_id for q_, r in exact.items()]) > 0.9
    assert S.lsh_plan(100_000)[0] > S.lsh_plan(1000)[0]


def test_graphs_against_brute_force(spark):
    """Clustered vectors in several shards: recall, order, repeats, rows that take no part, and equal graphs from equal rows."""
    from matchloom.operators import graph as GR
    from matchloom.plans.cut import cut

    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 24))
    z = centre[rng.integers(0, 12, 1800)] + 0.5 * rng.normal(size=(1800, 24))
    z /= np.linalg.norm(z, axis=1)[:, None]
    refs = [(i * 3 + 1, v.tolist()) for i, v in enumerate(z[:1600])] + [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 24), (None, z[0].tolist())]
    queries = [(i, v.tolist()) for i, v in enumerate(z[1600:])] + [(900, None), (901, z[5].tolist())]
    r = spark.createDataFrame(refs, "ref_id long, z array<double>")
    q = spark.createDataFrame(queries, "q long, z array<double>")
    index = cut(GR.build(r.repartition(3), shard_rows=400))
    assert index.count() == 5 and sum(len(x.ids) // 8 for x in index.collect()) == 1600
    assert sorted(bytes(x.links) for x in index.collect()) == sorted(bytes(x.links) for x in GR.build(r.repartition(7), shard_rows=400).collect())
    got = {}
    for x in GR.search(q, index, ["q"], 10, query_rows=50).orderBy("q", "rank").collect():
        got.setdefault(x.q, []).append((x.ref_id, x.s))
    assert set(got) == {*range(200), 901} and got[901][0][0] == 16
    hits = 0
    for i in range(200):
        s = z[:1600] @ z[1600 + i]
        hits += len({int(j) * 3 + 1 for j in np.argsort(-s)[:10]} & {a for a, _ in got[i]})
        assert all(abs(s[(a - 1) // 3] - b) < 1e-12 for a, b in got[i]) and [b for _, b in got[i]] == sorted((b for _, b in got[i]), reverse=True)
    assert hits / 2000 >= 0.95
    assert GR.search(q, GR.build(r.limit(0)), ["q"], 3).count() == 0
    few = GR.build(r.filter("ref_id < 8"))
    assert sorted(x.ref_id for x in GR.search(q.filter("q = 0"), few, ["q"], 9).collect()) == [1, 4, 7]


def test_long_chains_of_conflicts(spark):
    """A chain of 90 conflicts takes 45 rounds; the kernel and the rounds agree."""
    items = spark.createDataFrame([(0, i) for i in range(91)], "grp long, rank long")
    chain = spark.createDataFrame([(0, i + 1, i) for i in range(90)], "grp long, rank long, before long")
    want = [(0, i) for i in range(0, 91, 2)]
    assert sorted((r.grp, r.rank) for r in G.first_fit(items, chain).collect()) == want
    short = chain.filter("rank <= 24")
    assert sorted(r.rank for r in G.first_fit(items, short, most=3).collect()) == sorted([*range(0, 25, 2), *range(25, 91)])


def test_cover_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(int(y), int(a), int(b)) for y, a, b in rng.integers(0, [3, 14, 14], (130, 3))} | {(y, i, i) for y in range(3) for i in range(14)})
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1)], "label_id int, a long, b long")
    want = []
    for y in range(3):
        left, step = {b for l, _, b in rows if l == y}, 0
        while left:
            best = max(sorted({a for l, a, _ in rows if l == y}), key=lambda a: len({b for l, a_, b in rows if (l, a_) == (y, a)} & left))
            left -= {b for l, a, b in rows if (l, a) == (y, best)}
            want.append((y, step, best))
            step += 1
    for most in (2_000_000, 5):
        assert sorted((r.label_id, r.step, r.ref_id) for r in G.greedy_cover(df, most).collect()) == want
    assert G.greedy_cover(df.limit(0)).count() == 0


def test_width_against_brute_force(spark, sf):
    from matchloom.plans import views as V

    m = V.pred(spark, sf).filter("mask_no < 12")
    edges = {}
    for r in N.nested(m).collect():
        edges.setdefault(r.scene_id, set()).add((r.a, r.b))
    for r in N.widths(m, N.nested(m)).collect():
        e = edges.get(r.scene_id, set())
        reach = set(e)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        best = max(sum(1 for i in range(12) if x >> i & 1) for x in range(1 << 12) if not any(x >> a & 1 and x >> b & 1 for a, b in reach))
        assert r.width == best


def test_near_duplicate_ratio(spark):
    m = masks(spark, [(0, 0, 100, 100), (0, 0, 100, 88)])
    kept = lambda r: [x.mask_no for x in N.select(m, r).collect()]
    assert kept((4, 5)) == kept((88, 100)) == [1] and kept((89, 100)) == [0]


def test_debias_against_brute_force(spark, sf):
    from matchloom.operators import seam
    from matchloom.plans.catalog import QUERIES

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    noise = seam.StubEncoder(64).patch_features(seam.noise_input(14, (112, 112)))
    u = np.linalg.svd(noise, full_matrices=False)[2][:2]
    z = np.stack(e.embedding).astype(float)
    want = dict(zip(e.vec_id, np.linalg.norm(z - (z @ u.T) @ u, axis=1)))
    got = QUERIES["debias_project"](spark, sf).collect()
    assert len(got) == len(e) and all(r.left == pytest.approx(want[r.vec_id], abs=1e-6) for r in got)


def test_kappa_query_against_brute_force(spark, tmp_path):
    """More than 20,000 pairs above the threshold; kappa solves model threshold = quantile threshold."""
    from matchloom.plans.catalog import QUERIES

    rng = np.random.default_rng(7)
    ids = [*range(2, 4000, 4), *range(1, 1100, 2)]
    z = rng.normal(size=(len(ids), 4)) * np.where(np.array(ids) % 2, 0.05, 1.0)[:, None] + np.where(np.array(ids) % 2, 1.0, 0.0)[:, None] * [1, 0, 0, 0]
    spark.createDataFrame([(i, i % 10, v.tolist()) for i, v in zip(ids, z, strict=True)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.eps: r for r in QUERIES["kappa_calibration"](spark, str(tmp_path)).collect()}
    refs = [i for i in ids if i % 2 and i % 50 != 49]
    q = z[np.array(ids) % 2 == 0].astype(np.float32).astype(float)
    s = q @ z[np.isin(ids, refs)].astype(np.float32).astype(float).T
    pairs, n = np.sort(s.ravel()), len(refs)
    for eps in (0.05, 0.01):
        r = got[str(eps)]
        assert r.tau_q == pytest.approx(np.quantile(s.max(axis=1), 1 - eps))
        level = lambda kappa: np.quantile(pairs, (1 - eps) ** (1 / (kappa * n)))  # noqa: E731, B023
        assert r.out_of_range == (not level(1e-3) <= r.tau_q <= level(1.0))
        if not r.out_of_range:
            assert r.tau_m >= r.tau_q and r.tau_m == pytest.approx(r.tau_q, abs=1e-6)
    assert not all(r.out_of_range for r in got.values())


def test_growth_watch_goes_on_after_a_restart(spark, tmp_path):
    from matchloom.streaming import growth

    rows = lambda a, b: spark.createDataFrame([(i, 0, i, i % 10 == 9, [1.0]) for i in range(a, b)], growth.SCHEMA)
    rows(0, 20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(growth.SCHEMA).parquet(f"{tmp_path}/in")
    check = lambda df: (df.filter("insert_no % 2 = 0").count(), df.count())
    first = growth.watch(stream(), f"{tmp_path}/w", 100, 0.2, check, 0.4).collect()
    assert [(r.added, r.n, r.recalibrate, r.exceeded) for r in first] == [(18, 118, False, True)]
    rows(20, 50).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = growth.watch(stream(), f"{tmp_path}/w", 100, 0.2).orderBy("batch").collect()
    assert [(r.added, r.n, r.recalibrate) for r in again] == [(18, 118, False), (27, 145, True)]
    assert growth.watch(stream(), f"{tmp_path}/w", 100, 0.2).count() == 2


def test_growth_rules_on_a_fixture(spark, sf):
    """The quantile rules of one chain against NumPy."""
    from matchloom.plans import views as V
    from matchloom.plans.catalog import QUERIES

    got = {(r.r, r.n0, r.n, r.eps, r.rule): r for r in QUERIES["growth_rules"](spark, sf).collect()}
    assert len(got) == 9 * 6 * 2 * 5
    q = V.query(spark, sf).filter("NOT known").select("vec_id", "z").toPandas()
    r_ = V.ref(spark, sf).select("label_id", "z").toPandas()
    s = np.stack(q.z).astype(float) @ np.stack(r_.z).astype(float).T
    chain = V.chain(spark, sf).filter("r = 4").toPandas()
    star = {n: s[:, r_.label_id.isin(chain[chain.pos < n].label_id)].max(axis=1) for n in (3, 5, 10)}
    for n0, n in ((3, 5), (5, 10), (3, 3)):
        frozen = got[4, n0, n, 0.05, "quantile_frozen"]
        assert frozen.tau == pytest.approx(np.quantile(star[n0], 0.95)) and frozen.fpr == pytest.approx((star[n] >= frozen.tau).mean(), abs=1e-9)
        assert got[4, n0, n, 0.05, "quantile_recal"].tau == pytest.approx(np.quantile(star[n], 0.95))
        assert got[4, n0, n, 0.01, "fixed"].fpr == pytest.approx((star[n] >= 0.35).mean(), abs=1e-9)
    rows = {n: r_.label_id.isin(chain[chain.pos < n].label_id).to_numpy() for n in (3, 5, 10)}
    for (n0, n), eps in [(x, e) for x in ((3, 3), (3, 10), (5, 10), (10, 10)) for e in (0.05, 0.01)]:
        pairs, refs, target = np.sort(s[:, rows[n0]].ravel()), int(rows[n0].sum()), float(np.quantile(star[n0], 1 - eps))
        m = got[4, n0, n, eps, "model"]
        ends = [plain_threshold(pairs, eps, k, refs) for k in C.KAPPA]
        assert (m.tau is None) == (not ends[0] <= target <= ends[1])
        if m.tau is not None:
            lo, hi = (math.log(k) for k in C.KAPPA)
            while hi - lo > 1e-12:
                lo, hi = ((lo + hi) / 2, hi) if plain_threshold(pairs, eps, math.exp((lo + hi) / 2), refs) < target - 1e-12 else (lo, (lo + hi) / 2)
            assert m.tau == pytest.approx(plain_threshold(pairs, eps, math.exp(hi), int(rows[n].sum())), abs=1e-7)
    said = {(r.eps, r.rule): r.majority for r in QUERIES["growth_rules_verdict"](spark, sf).collect()}
    for r in QUERIES["verdict_rejection"](spark, sf).collect():
        model, quantile, fixed = (said[r.eps, x] for x in ("model", "quantile_recal", "fixed"))
        assert r.refined == ("a" if model else "b" if quantile else "c") and r.as_written == (None if not model and fixed else r.refined)


@pytest.mark.parametrize("name", ["growth_rules", "verdict_rejection"])
def test_growth_multiplies_pairs_thrice(spark, sf, monkeypatch, name):
    """Counts, what lies about the thresholds, and the model's thresholds if any kappa is in range: one pass over all pairs each, for all chains and rates."""
    from matchloom.plans.catalog import QUERIES

    passes, gather = [], S.Pairs.gather
    monkeypatch.setattr(S.Pairs, "gather", lambda *x: passes.append(x[2]) or gather(*x))
    assert QUERIES[name](spark, sf).columns and passes in ([RK.COUNTS, RK.AROUND], [RK.COUNTS, RK.AROUND, RK.VALUES])


@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_a_floor_changes_no_rank(spark, monkeypatch, scale):
    """Groups, equal vectors, many cells, norms beyond single precision; what lies below the floor is counted, and found by passes anew."""
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 4 * 100)
    monkeypatch.setattr(S, "CELL_QUERIES", 128)
    rng = np.random.default_rng(11)
    a, b = scale * rng.normal(size=(400, 4)), rng.normal(size=(300, 4))
    a[:50], b[:40], a[60] = a[0], b[0], 0.0
    label = np.arange(300) % 3
    s = a @ b.T
    frame = lambda z, id_: spark.createDataFrame([(i, i % 3, i, x.tolist()) for i, x in enumerate(z)], f"{id_} long, label_id int, insert_no long, z array<double>")
    passes, gather = [], S.Pairs.gather
    monkeypatch.setattr(S.Pairs, "gather", lambda *x: passes.append(x[2]) or gather(*x))
    floor = float(np.quantile(s, 0.99))
    source = lambda: RK.pairs(frame(a, "q"), frame(b, "ref_id"), by=lambda own, r: r.label_id[None, :], floor=floor)
    sets = {0: [0], 1: [1, 2], 2: [0, 1, 2], 3: [9]}
    of = {k: s[:, np.isin(label, v)].ravel() for k, v in sets.items()}
    d = RK.Ranks(source(), sets)
    assert d.source.pairs.rough == (np.float32 if scale == 1 else np.float64) and d.n == {k: len(v) for k, v in of.items()}
    which, q = np.repeat([0, 1, 2], 3), np.tile([0.9935, 0.999, 1.0], 3)
    assert np.allclose(d.quantiles(which, q), [np.quantile(of[k], p) for k, p in zip(which.tolist(), q.tolist(), strict=True)], rtol=1e-12)
    high = np.unique(s[s > floor])
    at = int(np.diff(high).argmax())
    levels = np.array([(high[at] + high[at + 1]) / 2, scale * 1e3])

    def right(got, levels):
        for k, v in of.items():
            for i, x in enumerate(levels.tolist()):
                below, equal, under, over = got[k, i]
                assert (below, equal) == ((v < x).sum(), 0)
                assert under == pytest.approx(max(v[v < x], default=-np.inf)) and over == pytest.approx(min(v[v >= x], default=np.inf))

    right(d.around(levels), levels)
    assert passes == [RK.COUNTS, RK.VALUES, RK.AROUND]
    assert np.allclose(d.quantiles(np.array([1, 2]), np.array([0.2, 0.999])), [np.quantile(of[1], 0.2), np.quantile(of[2], 0.999)], rtol=1e-12)
    assert passes.count(RK.COUNTS) == 2
    levels = np.array([floor, -scale])
    right(RK.Ranks(source(), sets).around(levels), levels)


def test_best_of_labels_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 5 * 40)
    monkeypatch.setattr(S, "CELL_QUERIES", 30)
    rng = np.random.default_rng(12)
    z, q = rng.normal(size=(130, 5)).astype(np.float32), rng.normal(size=(70, 5)).astype(np.float32)
    refs = vectors(spark, [(i, i % 7 if i != 100 else 50, i, v.tolist()) for i, v in enumerate(z)] + [(900, None, 900, z[0].tolist()), (901, 1, 901, None)])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(900, None), (901, [1.0])], "q long, z array<float>")
    got = {}
    for r in S.Pairs(queries, refs, ["q"]).best([1, 4, 50, 60]).collect():
        got[r.q] = np.maximum(got.get(r.q, -np.inf), np.frombuffer(r.m))
    s, label = q.astype(float) @ z.astype(float).T, np.array([i % 7 if i != 100 else 50 for i in range(130)])
    assert set(got) == set(range(70))
    for i in range(70):
        assert np.allclose(got[i][:3], [s[i, label == x].max() for x in (1, 4, 50)], rtol=1e-12) and got[i][3] == -np.inf


@pytest.mark.parametrize("name", ["growth_rules", "verdict_rejection"])
def test_growth_looks_at_pairs_from_a_floor_on(spark, sf, monkeypatch, name):
    """What the thresholds ask for lies above the median of the queries' best; passes do not look below it, and answers are no join of labels, chains and sizes."""
    from matchloom.plans.catalog import QUERIES

    floors, pairs = [], RK.pairs
    monkeypatch.setattr(RK, "pairs", lambda *x, **k: floors.append(k.get("floor")) or pairs(*x, **k))
    monkeypatch.setattr(S, "similarities", None)
    assert QUERIES[name](spark, sf).columns and len(floors) == 1 and floors[0] > 0


@pytest.mark.parametrize("held", [1 << 22, 100])
def test_top_takes_one_pass(spark, monkeypatch, held):
    """Each cell keeps its own largest; ties at the last place, all pairs, and more than a cell may hold."""
    monkeypatch.setattr(RK, "TOP_HELD", held)
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 4 * 100)
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(90, 4)), rng.normal(size=(250, 4))
    a[:30], b[:40] = a[0], 3 * a[0]
    s = np.sort((a @ b.T).ravel())
    frame = lambda z, id_: spark.createDataFrame([(i, 0, i, x.tolist()) for i, x in enumerate(z)], f"{id_} long, label_id int, insert_no long, z array<double>")
    passes, gather = [], S.Pairs.gather
    monkeypatch.setattr(S.Pairs, "gather", lambda *x: passes.append(x[2]) or gather(*x))
    for k in (700, 5000, len(s) + 1):
        assert np.allclose(np.sort([r.s for r in RK.top(frame(a, "q"), frame(b, "ref_id"), k).collect()]), s[-k:], rtol=1e-12, atol=1e-15)
        assert (passes == ["s double"]) == (k <= held)
        passes.clear()


def test_a_large_gallery_meets_queries_in_many_tasks(spark, monkeypatch, pool):
    """Queries of one partition are dealt out, broadcast and grid alike; a cell's blocks leave it one by one."""
    monkeypatch.setattr(S, "SPREAD_REFS", 20)
    monkeypatch.setattr(S, "TILE", (1, 8))
    _, refs, queries = pool
    for limit in (64 << 20, 400):
        monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
        assert S.similarities(queries.coalesce(1), refs, ["q"]).rdd.getNumPartitions() >= 3


def test_graph_recall_asks_for_every_fiftieth_id(spark, sf):
    from matchloom.plans import views as V
    from matchloom.plans.catalog import QUERIES

    assert QUERIES["graph_recall"](spark, sf).collect()[0].n == V.query(spark, sf).filter("vec_id % 50 = 0").count() > 0


def test_pool_equals_pooled_over_all_components(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(12, 9)).astype(np.float32)
    rows = [(i % 3, i, 0 if i % 3 == 2 else i % 4, z[i].tolist()) for i in range(12)]
    got = X.pool(spark.createDataFrame(rows, "label int, at long, w long, z array<float>"), "label", "at", "w", "z").orderBy("i").collect()
    for label in range(3):
        mine = [r for r in rows if r[0] == label]
        want = X.pooled(np.array([r[3] for r in mine]), np.array([r[2] for r in mine]), 1)  # of 2, 5, 8, 11, the middle is 6.5
        assert np.allclose([r.v for r in got if r.label == label], want) and np.linalg.norm(want) == pytest.approx(1)
        assert label != 2 or np.allclose(want, z[5] / np.linalg.norm(z[5]))
    with pytest.raises(ValueError):
        X.pooled(z, np.zeros(12))


def test_patch_grid_mask():
    m = np.zeros((9, 8), bool)
    m[0:3, 0:4] = True
    assert np.allclose(X.patch_grid_mask(m, (9, 8), 4), [[0.75, 0.0], [0.0, 0.0]])
    assert np.allclose(X.patch_grid_mask(np.ones((10, 7)), (5, 4), 2), 1.0)
    assert np.allclose(X.patch_grid_mask(np.array([[1, 1, 0]]), (1, 2), 1), [[1.0, 1 / 3]])
    with pytest.raises(ValueError):
        X.patch_grid_mask(m, (4, 4), 2, resize=False)


def test_boot_ap_over_weight_vectors(spark, tmp_path):
    """Vectors of 1,000 replicates give the AP of every replicate and category that a row for each detection and replicate gives."""
    from matchloom.plans import catalog_scenes as K
    from matchloom.plans import views
    from matchloom.plans.catalog import QUERIES
    from matchloom.plans.cut import cut

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey < 400").write.parquet(f"{tmp_path}/lineitem.parquet")
    m, g = K._eval(spark, str(tmp_path))
    m, g, w = cut(m), cut(g), cut(views.boot(g, 1000))
    g = g.filter("gt_label <> 3")  # a category of detections without ground truth, and one of ground truth without detections
    m = m.filter("cat <> 5")
    want = {(r.b, r.cat): (r.npig, r.ap) for r in M.average_precision(m, M.gt_counts(g), w).collect()}
    for bounds in ([], [0.1, 0.45, 0.450001, 0.8]):
        got = {(r.b, r.cat): (r.npig, r.ap) for r in M.bootstrap_ap(m, M.gt_counts(g), w, 1000, bounds).collect()}
        assert set(got) == set(want) and len(got) > 3000 and all(got[k][0] == want[k][0] for k in got)
        assert np.allclose([got[k][1] for k in got], [want[k][1] for k in got], atol=1e-12)
    r = QUERIES["boot_ap_ci"](spark, str(tmp_path)).collect()[0]
    assert r.replicates == 1000 and 0 <= r.lo <= r.hi <= 1


def test_paired_ap_by_subset(spark, tmp_path):
    """Differences of two subsets against AP computed for each of them by itself."""
    from matchloom.plans import catalog_eval as CE
    from matchloom.plans import catalog_scenes as K
    from matchloom.plans import views
    from matchloom.plans.catalog import QUERIES
    from matchloom.plans.cut import cut

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey < 300").write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = str(tmp_path)
    got = {(r.subset, r.b): (r.ap, r.ap50) for r in CE.paired_ap(spark, sf, 6).collect()}
    pred, truth = cut(views.pred(spark, sf)), cut(K._truth(spark, sf)[1])
    kept = N.select(pred).withColumnRenamed("mask_no", "det_no")
    w = cut(views.boot(views.gt(spark, sf), 6))
    for subset, cond in (("all/all", "true"), ("test/1", "scene_id % 4 <> 0 AND scene_id % 3 = 1")):
        d = pred.filter(cond).withColumnRenamed("mask_no", "det_no")
        g, value = truth.filter(cond), {}
        for name, x in (("kept", d.join(kept, ["scene_id", "det_no"], "left_semi")), ("all", d)):
            ap = M.ap_by_threshold(M.packed(x, g), M.gt_counts(g), ["b", "cat"], w).groupBy("b").agg(F.avg(M.mean_of(F.col("aps"))).alias("ap"), F.avg(F.get("aps", F.lit(0))).alias("ap50"))
            value[name] = {r.b: (r.ap, r.ap50) for r in ap.collect()}
        assert {b for s, b in got if s == subset} == set(value["all"])
        for b in value["all"]:
            assert got[subset, b] == pytest.approx([x - y for x, y in zip(value["kept"][b], value["all"][b])], abs=1e-12)
    rows = QUERIES["paired_ap_diff"](spark, sf).collect()
    assert {r.metric for r in rows} == {"ap", "ap50"} and all(r.outcome == (1 if r.lo > 0 else 3 if r.hi < 0 else 2) for r in rows)


def test_sums_in_parts(spark):
    """Running sums in parts equal those of one sort, with nulls, groups that are null, and more rows than parts."""
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), float(v), int(n)) for g, v, n in zip(rng.integers(0, 4, 4000), rng.permutation(4000) / 7.0, rng.integers(0, 9, 4000))] + [(0, None, 5)]
    got = M.summed_below(spark.createDataFrame(rows, "g int, v double, n long"), ["g"], "v", "n", "under").collect()
    key = lambda v: -math.inf if v is None else v
    assert len(got) == 4001 and all(r.under == sum(n for g, v, n in rows if g == r.g and key(v) < key(r.v)) for r in got[::40])


def test_ranks_of_a_column(spark):
    """Negative, tiny, huge and equal numbers; nulls and non-finite ones left out; what reaches the driver is bounded by what is asked."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), np.repeat([0.0, -0.0, 1.0, 5e-324, -1.7e308], 50), np.round(rng.normal(size=2000), 2)])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan")), (2, float("inf")), (None, 1.0), (-1, 2.0)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    r = RK.Ranks(RK.column(df, "v", "g"), {0: [0], 9: [1, 2]})
    parts = {0: np.sort(x[0::3]), 9: np.sort(np.concatenate([x[1::3], x[2::3]]))}
    assert r.n == {k: len(v) for k, v in parts.items()}
    for k, v in parts.items():
        assert r.values(np.full(len(v), k), np.arange(len(v))).tolist() == (v + 0.0).tolist()
    assert np.array_equal(RK.numbers(RK.codes(x)), x + 0.0) and (np.diff(RK.codes(np.sort(x)).astype(object)) >= 0).all()
    with pytest.raises(ValueError):
        r.values(np.array([0]), np.array([len(parts[0])]))


def test_few_values_reach_the_driver(spark, monkeypatch):
    """Asking for 50 ranks of 40,000 numbers in one narrow range brings 50 rows a pass, not the numbers."""
    df = spark.range(40_000).select((F.lit(0.5) + F.col("id") * 1e-12).alias("v"))
    r = RK.Ranks(RK.column(df, "v"))
    seen, plain = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: seen.append(plain(self).num_rows) or plain(self))
    ranks = np.arange(0, 40_000, 800)
    assert np.allclose(r.values(np.zeros(50, int), ranks), 0.5 + ranks * 1e-12, rtol=0, atol=1e-16)
    assert seen and max(seen) <= 50


def test_draws_equal_numpy(spark, sf):
    """Whole streams in small chunks, with rejections; weights by subset and chains of labels as the queries give them."""
    from matchloom.functions import draws as D
    from matchloom.plans import catalog_eval as CE
    from matchloom.plans import catalog_gallery as CG
    from matchloom.plans import views as V
    from matchloom.plans.catalog import QUERIES

    for seed, high, n in ((5, 7, 1000), ([3, 1], 120, 4001), (11, 3_000_000_000, 900), (2, 2**32 - 1, 50), (4, 1, 5), (9, 2, 0)):
        got = [r.value for r in D.integers(spark, seed, high, n, chunk=64).orderBy("i").collect()]
        assert got == np.random.default_rng(seed).integers(0, high, n).tolist()
    of = CE._of(spark, sf).toPandas()
    got = {(r.subset, r.b, r.scene_id): r.w for r in QUERIES["boot_weights_seeded"](spark, sf).collect()}
    want = {}
    for i, name in enumerate(sorted(of.subset.unique())):
        sel = np.sort(of.scene_id[of.subset == name].to_numpy())
        drawn = sel[np.random.default_rng([CG.SEED, i]).integers(0, len(sel), (50, len(sel)))]
        for b, row in enumerate(drawn):
            for scene, w in zip(*np.unique(row, return_counts=True)):
                want[name, b, int(scene)] = int(w)
    assert got == want
    labels = sorted(r.label_id for r in V.ref(spark, sf).select("label_id").distinct().collect())
    chains = {(r.r, r.pos): r.label_id for r in QUERIES["gallery_chains_seeded"](spark, sf).collect()}
    assert chains == {(r, p): labels[j] for r in range(9) for p, j in enumerate(np.random.default_rng(CG.SEED + r).permutation(len(labels)))}


def test_weights_of_all_sets_in_one_join(spark):
    """Sets of scenes draw from their own streams at once, and nothing is broadcast, whatever the threshold."""
    from matchloom.functions import draws as D

    sizes = {0: 7, 1: 1, 3: 40}  # set 2 has no scenes
    scenes = spark.createDataFrame([(k, i, 1000 * k + i) for k, n in sizes.items() for i in range(n)], "stream long, i long, scene_id long")
    got = D.boot_weights_by(scenes, [[5, k] for k in range(4)], 9)
    want = {}
    for k, n in sizes.items():
        for b, row in enumerate(np.random.default_rng([5, k]).integers(0, n, (9, n))):
            for i, w in zip(*np.unique(row, return_counts=True)):
                want[k, b, 1000 * k + int(i)] = int(w)
    assert {(r.stream, r.b, r.scene_id): r.w for r in got.collect()} == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_scene_matches_like_its_groups(spark):
    """match_scene against match_group by category and range: rivals, crowds, ties, empty boxes, no ground truth; ignored rows can be left out."""
    from matchloom.operators import metrics as M

    rng = np.random.default_rng(1)
    ranges = (("all", 0.0, 1e10), ("small", 0.0, 99.5), ("large", 100.0, 1e10))
    for n, m in ((0, 3), (5, 0), (40, 12), (60, 30)):
        box = lambda k: dict(zip(("x0", "y0", "x1", "y1"), np.concatenate([c := rng.integers(0, 8, (2, k)), c + rng.integers(0, 13, (2, k))]).astype(float)))  # noqa: E731, B023
        det = {"cat": np.sort(rng.integers(0, 3, n)), "no": np.arange(n), "score": np.zeros(n), **box(n)}
        gt = {"cat": rng.integers(0, 3, m), "no": rng.integers(-1, m, m), "crowd": rng.random(m) < 0.2, **box(m)}
        for (name, lo, hi), (got, hits, skips, nos) in zip(ranges, M.match_scene(det, gt, M.IOU_THRESHOLDS, ranges)):
            assert name == got
            for cat in range(3):
                d, g = det["cat"] == cat, gt["cat"] == cat
                one = {"det_no": det["no"][d], "score": det["score"][d], **{c: det[c][d] for c in ("x0", "y0", "x1", "y1")}}
                two = {"gt_no": gt["no"][g], "iscrowd": gt["crowd"][g], **{c: gt[c][g] for c in ("x0", "y0", "x1", "y1")}}
                want = M.match_group(one, two, M.IOU_THRESHOLDS, lo, hi, 100)
                by = lambda c: want[c].reshape(10, -1).T  # noqa: E731, B023
                assert np.array_equal((hits[d, None] >> np.arange(10)) & 1, by("matched")) and np.array_equal((skips[d, None] >> np.arange(10)) & 1, by("ignored")) and np.array_equal(nos[d], by("gt_no"))
    d = spark.createDataFrame([(1, k, 0, 0.5, 0.0, 0.0, 5.0 * k, 5.0) for k in (1, 9)], "scene_id long, det_no long, label_id int, score double, x0 double, y0 double, x1 double, y1 double")
    g = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 5.0, 5.0, False)], "scene_id long, gt_no long, gt_label int, x0 double, y0 double, x1 double, y1 double, iscrowd boolean")
    assert M.packed(d, g, ranges=ranges).count() == 6 and M.packed(d, g, ranges=ranges, counted=True).count() == 4


def test_sums_of_weights_leave_a_task_once_a_key(spark, monkeypatch):
    """Totals of parts are summed before any shuffle, with weights of 8 and of 16 bits; full tasks give the same."""
    from matchloom.operators import metrics as M

    rows = spark.createDataFrame([(s, "all", s % 2, r, float((s * 7 + r) % 5), 1023 if (s + r) % 3 else 7, 8 if r else 0) for s in range(30) for r in range(4)], "scene_id long, area string, cat int, rank long, score double, hits int, skips int").repartition(3)
    counts = spark.createDataFrame([(s, s % 2, 5) for s in range(30)], "scene_id long, cat int, n long")
    w = spark.createDataFrame([(b, s, 400 if s == 3 and b == 2 else (s + b) % 3) for b in range(3) for s in range(30)], "b long, scene_id long, w long")
    want = {(r.b, r.cat): (r.npig, r.ap) for r in M.average_precision(rows, counts, w).collect()}
    for held in (M.SUMS_HELD, 1):
        monkeypatch.setattr(M, "SUMS_HELD", held)
        got = {(r.b, r.cat): (r.npig, r.ap) for r in M.bootstrap_ap(rows, counts, w, 3, [1.0, 3.0]).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-12 for k, v in want.items())


def test_lsh_codes_leave_in_small_batches():
    """Whatever the tables, few rows leave at once; the codes are those of the whole product."""
    import pyarrow as pa

    from matchloom.operators import search as S

    rng = np.random.default_rng(4)
    tables, bits, z = 900, 7, rng.normal(size=(500, 8))
    p = rng.normal(size=(tables * bits, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([None if k == 3 else v.tolist() for k, v in enumerate(z)], pa.list_(pa.float64()))], ["vec_id", "z"])
    out = list(S.lsh_codes(p, tables)(iter([batch])))
    assert max(b.num_rows for b in out) <= S.CODES_AT_ONCE
    want = ((z @ p.T > 0).reshape(500, tables, bits) * (1 << np.arange(bits))).sum(axis=2)
    got = {(v, t): c for b in out for v, t, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())}
    assert got == {(v, t): int(want[v, t]) for v in range(500) if v != 3 for t in range(tables)}


def test_weightings_in_blocks(spark, monkeypatch):
    """Blocks of weightings, runs of detections and weights of 8 and 16 bits give the AP of every weighting; vectors hold the weights of ``boot``."""
    from matchloom.operators import metrics as M
    from matchloom.plans import views

    rows = spark.createDataFrame([(s, "all", s % 2, r, None if s == 5 else float((s * 7 + r) % 5), 1023 if (s + r) % 3 else 7, 8 if r else 0) for s in range(30) for r in range(4)], "scene_id long, area string, cat int, rank long, score double, hits int, skips int").repartition(3).fillna(float("-inf"))
    counts = spark.createDataFrame([(s, c, 5) for s in range(30) for c in (s % 2, 7)], "scene_id long, cat int, n long")
    w = spark.createDataFrame([(b, s, 400 if s == 3 and b == 2 else (s + b) % 3) for b in range(40) for s in range(30) if (s + b) % 3], "b long, scene_id long, w long")
    want = {(r.b, r.cat): (r.npig, r.ap) for r in M.average_precision(rows, counts, w).collect()}
    monkeypatch.setattr(M, "RUN", 4)
    for width in (16, 128):
        monkeypatch.setattr(M, "WIDTH", width)
        got = {(r.b, r.cat): (r.npig, M.np.mean(r.aps)) for r in M.blocked_ap(rows, counts, w, 40, ["cat"], [1.0, 3.0]).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-12 for k, v in want.items())
    scenes = spark.range(100, 160).withColumnRenamed("id", "scene_id")
    one = {(r.b, r.scene_id): r.w for r in views.boot(scenes, 70).collect()}
    two = {(b, r.scene_id): n for r in views.boot_vectors(scenes, 70).collect() for b, n in enumerate(r.wv) if n}
    assert one == two and sum(one.values()) == 60 * 70


def test_selection_found_in_one_reading_of_a_scene(spark):
    """Flags and counts of one kernel a scene are those of ``select``, ``maximal`` and ``best_per_gt``; a mask without a box is in no pair."""
    from matchloom.operators import boxes as B
    from matchloom.operators import nesting as N

    rng = np.random.default_rng(11)
    at = rng.integers(0, 12, size=(160, 2))
    box = np.concatenate([at, at + rng.integers(1, 14, size=(160, 2))], axis=1).astype(float).tolist()
    box[7] = [None] * 4
    m = spark.createDataFrame([(k // 40, k % 40, 0, *b) for k, b in enumerate(box)], "scene_id long, mask_no long, label_id int, x0 double, y0 double, x1 double, y1 double")
    g = spark.createDataFrame([(k // 9, k % 9, 0, float(k % 5), 2.0, float(k % 5 + 9), float(8 + k % 6)) for k in range(45)], "scene_id long, gt_no long, gt_label int, x0 double, y0 double, x1 double, y1 double")
    want: dict = {}
    for name, kept in (("every", m), ("rho", N.select(m)), ("top", N.maximal(m, N.nested(m)))):
        for r in B.best_per_gt(g, m.join(kept, ["scene_id", "mask_no"], "left_semi")).collect():
            want[r.scene_id, name] = want.get((r.scene_id, name), 0) + (r.best_iou >= 0.5)
    rows = N.found(g, m.repartition(5)).collect()
    assert len(rows) == 5 and {(r.scene_id, c): r[c] for r in rows for c in ("every", "rho", "top")} == want and all(r.den == 9 for r in rows)
    assert sum(r.rho for r in rows) < sum(r.every for r in rows)


def test_recall_variants_from_two_matchings(spark, tmp_path, monkeypatch):
    """All variants are those that a matching for each of them gives, and two matchings serve all."""
    from matchloom.operators import composite as E
    from matchloom.plans import catalog_eval as CE
    from matchloom.plans import catalog_scenes as K
    from matchloom.plans import views
    from matchloom.plans.cut import cut

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey < 150").write.parquet(f"{tmp_path}/lineitem.parquet")
    sf, calls, packed = str(tmp_path), [], E.M.packed
    m, truth, of = cut(views.pred(spark, sf)), cut(K._truth(spark, sf)[1]), cut(CE._of(spark, sf))
    monkeypatch.setattr(E.M, "packed", lambda *a, **k: calls.append(1) or packed(*a, **k))
    got = {tuple(r) for r in E.recall_variants(m, truth, of, (1, 10)).collect()}
    assert len(calls) == 2
    one = E.recall(m.withColumnRenamed("mask_no", "det_no"), truth, of, (1, 10), True, 0.4)
    assert {tuple(r) for r in one.collect()} == {r for r in got if r[1] and r[2] == 0.4} != set()


def test_paired_recall_takes_one_reading_and_broadcasts_no_scenes(spark, sf, monkeypatch):
    """No selection by joins, no row for each scene and replicate, and scenes meet their weights in sorted joins, whatever may be broadcast."""
    from matchloom.operators import kernel as KE
    from matchloom.operators import nesting as N
    from matchloom.operators import stats as ST
    from matchloom.plans import catalog_scenes as K
    from matchloom.plans import views
    from matchloom.plans.catalog import QUERIES

    want = QUERIES["paired_recall_diff"](spark, sf).collect()
    monkeypatch.setattr(N, "select", None)
    monkeypatch.setattr(views, "boot", None)
    monkeypatch.setattr(KE, "PAIRS_AT_ONCE", 1000)
    assert QUERIES["paired_recall_diff"](spark, sf).collect() == want
    per = K.cut(N.found(views.gt(spark, sf), views.pred(spark, sf)))
    vectors = views.boot_vectors(per, 5)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 60))
    try:
        plan = ST.weighted_sums(per, vectors, 5, ["den"], [])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") <= 1  # the offsets of the partitions, by a hint


def test_pairs_within_in_parts(monkeypatch):
    from matchloom.operators import kernel as KE

    a, b = np.array([0, 0, 1, 3, 3]), np.array([3, 0, 2, 3, 0, 0])
    want = [(i, j) for i in range(5) for j in range(6) if a[i] == b[j]]
    for most in (1, 4, 1 << 20):
        monkeypatch.setattr(KE, "PAIRS_AT_ONCE", most)
        assert [(int(x), int(y)) for i, j in KE.pairs_within(a, b) for x, y in zip(i, j)] == want
    assert KE.places(np.array([5, 5, 7, 5])).tolist() == [0, 0, 1, 2] and not len(KE.places(np.zeros(0)))


def test_selection_is_matched_where_scenes_are_read(spark, sf, monkeypatch):
    """No selection by joins and no vector for each row; whole numbers of 60 bits stay whole; a box without finite sides meets all or none."""
    from matchloom.operators import metrics as M
    from matchloom.operators import nesting as N
    from matchloom.plans.catalog import QUERIES

    monkeypatch.setattr(N, "select", None)
    monkeypatch.setattr(M, "weighted_ap", None)
    assert QUERIES["evaluate_selected"](spark, sf).count() == 48
    rng = np.random.default_rng(4)
    at = rng.integers(0, 30, (300, 2))
    box, scene, no = np.concatenate([at, at + rng.integers(-1, 15, (300, 2))], axis=1).astype(float), np.sort(rng.integers(0, 6, 300)), np.arange(300)
    box[5] = np.nan
    for far in (box, np.where(np.arange(300)[:, None] == 9, [[-np.inf, 0, np.inf, 9]], box)):
        one = [N.chosen_of(no[scene == s], far[scene == s]) for s in range(6)]
        assert all(np.array_equal(a, np.concatenate(b)) for a, b in zip(N.chosen_of(no, far, scene=scene), zip(*one)))
        meet = {(i, j) for i in range(300) for j in range(300) if scene[i] == scene[j] and far[i, 0] < far[j, 2] and far[j, 0] < far[i, 2]}
        assert meet <= {(int(x), int(y)) for i, j in N._near(scene, far[:, 0], far[:, 2]) for x, y in zip(i, j)}


def test_oracle_masks_are_assigned_where_they_are_matched(spark, sf, monkeypatch):
    """The kernel's choice is that of ``oracle_assign`` and ``distractors``; the evaluation makes no table of either."""
    from matchloom.operators import boxes as B
    from matchloom.operators import composite as E
    from matchloom.operators import greedy as G
    from matchloom.operators import metrics as M
    from matchloom.plans import catalog_scenes as K
    from matchloom.plans import views
    from matchloom.plans.catalog import QUERIES

    m, g, z = K.cut(views.pred(spark, sf)), K.cut(views.gt(spark, sf)), K.cut(views.zones(spark, sf))
    known = {(r.scene_id, r.mask_no) for r in G.oracle_assign(g, m).collect() if r.mask_no >= 0}
    wrong = {(r.scene_id, r.mask_no) for r in B.distractors(g, m, z).collect()}
    scenes = m.select("scene_id").distinct().withColumn("sub", F.lit(1).cast("long"))
    dets = m.withColumnRenamed("mask_no", "det_no").withColumn("label_id", F.col("det_no").cast("int"))  # so that cat tells the mask
    rows = M.judged(dets, K._truth(spark, sf)[1], scenes, choose=E.assigned, more="known int, hit int, abin int").filter("rank >= 0").collect()
    assert {(r.scene_id, r["cat"]) for r in rows if r.known == 1} == known != set() and {(r.scene_id, r["cat"]) for r in rows if r.known == 0} == wrong != set()
    monkeypatch.setattr(G, "oracle_assign", None)
    monkeypatch.setattr(B, "distractors", None)
    assert QUERIES["evaluate_oracle"](spark, sf).count() == 48


def test_paired_ap_reads_a_scene_once(spark, tmp_path, monkeypatch):
    """One reading serves all and the selected masks, and no block of weightings meets every detection."""
    from matchloom.operators import metrics as M
    from matchloom.operators import nesting as N
    from matchloom.plans import catalog_eval as CE

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey < 200").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(N, "select", None)
    monkeypatch.setattr(M, "blocked_ap", None)
    calls, judged = [], M.judged
    monkeypatch.setattr(M, "judged", lambda *a, **k: calls.append(1) or judged(*a, **k))
    assert {r.subset for r in CE.paired_ap(spark, str(tmp_path), 3).select("subset").collect()} >= {"all/all", "test/1"} and len(calls) == 1


def test_weights_in_blocks_broadcast_no_scenes(spark, monkeypatch):
    """Whatever Spark may broadcast, scenes, their numbers and their vectors do not pass through the driver: only what is broadcast by a hint."""
    from matchloom.operators import metrics as M
    from matchloom.plans import views

    scenes = spark.range(40).withColumnRenamed("id", "scene_id")
    rows = spark.createDataFrame([(s, "all", s % 2, 0, 0.5, 1, 0) for s in range(40)], "scene_id long, area string, cat int, rank long, score double, hits int, skips int")
    counts = spark.createDataFrame([(s, s % 2, 1) for s in range(40)], "scene_id long, cat int, n long")
    plans, cut = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df: plans.append(df) or cut(df))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    count = {}
    for size in ("-1", str(1 << 60)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            plans.append(M.blocked_ap(rows, counts, views.boot_vectors(scenes, 70), 70, ["cat"], []))
            count[size] = sum(p._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") for p in plans)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        plans.clear()
    assert len(set(count.values())) == 1
