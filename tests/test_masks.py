"""Run algebra and mask operators against decoded masks."""

import numpy as np
import pytest

from matchloom.functions import runs as U
from matchloom.functions import scalar as X
from matchloom.operators import masks as K
from matchloom.operators import nesting as N


def decoded(m, h, w):
    flat = np.zeros(h * w, bool)
    for a, b in zip(*m):
        flat[a:b] = True
    return flat.reshape(w, h).T


def random_masks(rng, n, h, w):
    out = []
    for i in range(n):
        m = np.zeros((h, w), bool)
        for _ in range(rng.integers(0, 4)):
            y, x = rng.integers(0, h), rng.integers(0, w)
            m[y : y + rng.integers(1, h + 1), x : x + rng.integers(1, w + 1)] ^= True
        if i % 5 == 4:
            m = rng.random((h, w)) < 0.4
        out.append(m)
    return [*out, np.zeros((h, w), bool), np.ones((h, w), bool)]


def test_algebra_against_pixels():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (7, 5), (1, 9), (12, 1), (20, 30)):
        masks = random_masks(rng, 20, h, w)
        runs = [U.from_rle(X.rle_encode(m)) for m in masks]
        for m, r in zip(masks, runs):
            assert (decoded(r, h, w) == m).all() and U.area(r) == m.sum()
            assert X.rle_encode(m) == U.to_rle(r, (h, w))
            y, x = np.nonzero(m)
            assert U.box(r, h) == ((x.min(), y.min(), x.max() + 1, y.max() + 1) if m.any() and not _crosses(r, h) else U.box(r, h))
            if m.any():
                x0, y0, x1, y1 = U.box(r, h)
                assert (x0, x1) == (x.min(), x.max() + 1) and y0 <= y.min() and y1 >= y.max() + 1
        for _ in range(60):
            some = rng.integers(0, len(masks), rng.integers(1, 6))
            for least in (1, 2, len(some)):
                got = U.covered([runs[i] for i in some], least)
                assert (decoded(got, h, w) == (sum(masks[i].astype(int) for i in some) >= least)).all()
                assert (got[0][1:] > got[1][:-1]).all() and (got[0] < got[1]).all()
            a, b = some[0], some[-1]
            both = (masks[a] & masks[b]).sum()
            either = (masks[a] | masks[b]).sum()
            assert U.iou(runs[a], runs[b]) == pytest.approx(both / either if either else 0)
            assert (decoded(U.minus(runs[a], runs[b]), h, w) == (masks[a] & ~masks[b])).all()
            n = np.array([len(runs[i][0]) for i in some])
            shared = U.overlaps(runs[a], np.concatenate([runs[i][0] for i in some]), np.concatenate([runs[i][1] for i in some]), np.cumsum(n) - n)
            assert shared.tolist() == [(masks[a] & masks[i]).sum() for i in some]
    assert U.from_box((2, 0, 4, 5), 5) == (np.array([10]), np.array([20]))
    assert U.area(U.from_box((3, 2, 3, 9), 10)) == 0 and U.area(U.from_box((1, 4, 5, 4), 10)) == 0


def _crosses(r, h):
    return bool(((r[0] // h) != ((r[1] - 1) // h)).any())


def frame(spark, scenes):
    rows = [(s, i, r[0].tolist(), r[1].tolist()) for s, masks in scenes.items() for i, r in enumerate(masks)]
    return spark.createDataFrame([*rows, (0, 90, None, None), (None, 1, [0], [4])], "scene_id long, mask_no long, starts array<long>, ends array<long>").repartition(3)


def test_operators_against_pixels(spark):
    rng = np.random.default_rng(3)
    h, w = 16, 18
    masks = {s: random_masks(rng, 14, h, w) for s in range(4)}
    for s in masks:  # some that are nested
        masks[s] += [masks[s][3] & masks[s][4], np.pad(np.ones((8, 9), bool), ((2, 6), (3, 6))), np.pad(np.ones((8, 8), bool), ((2, 6), (3, 7))), np.pad(np.ones((8, 4), bool), ((2, 6), (8, 6)))]
    df = frame(spark, {s: [U.from_rle(X.rle_encode(m)) for m in v] for s, v in masks.items()})
    want = {(s, i, k): int((a & b).sum()) for s, v in masks.items() for i, a in enumerate(v) for k, b in enumerate(v) if i < k and (a & b).any()}
    got = {(r.scene_id, r.i, r.k): r for r in K.shared(df).collect()}
    assert {k: r.v for k, r in got.items()} == want and all(r.area_i == masks[r.scene_id][r.i].sum() for r in got.values())
    crossed = {(r.scene_id, r.i, r.k) for r in K.crossings(df).collect()}
    assert crossed == {(s, i, k) for (s, i, k), v in want.items() if 10 * v < 9 * min(masks[s][i].sum(), masks[s][k].sum())} and crossed
    for r in K.coverage(df).collect():
        depth = sum(m.astype(int) for m in masks[r.scene_id])
        assert (r.masks - (r.scene_id == 0), r.total, r.covered, r.twice) == (len(masks[r.scene_id]), depth.sum(), (depth > 0).sum(), (depth > 1).sum())
    edges = K.nested(df)
    plain = set()
    for (s, i, k), v in want.items():
        a, b = int(masks[s][i].sum()), int(masks[s][k].sum())
        if a != b and 10 * v >= 9 * min(a, b):
            plain.add((s, i, k) if a < b else (s, k, i))
    assert {(r.scene_id, r.a, r.b) for r in edges.collect()} == plain and plain
    up = N.parents(edges)
    parent = {(r.scene_id, r.mask_no): r.parent for r in up.collect()}
    keep = set()
    for s, v in masks.items():
        todo = [i for i in range(len(v)) if (s, i) not in parent] + ([90] if s == 0 else [])
        while todo:
            i = todo.pop()
            kids = [k for k in range(len(v)) if parent.get((s, k)) == i]
            if len(kids) >= 2 and (np.any([v[k] for k in kids], axis=0) & v[i]).sum() >= 0.5 * v[i].sum():
                todo += kids
            else:
                keep.add((s, i))
    assert {(r.scene_id, r.mask_no) for r in K.split(df, up).collect()} == keep
    assert K.shared(df.limit(0)).count() == 0


def test_boxes_as_runs(spark):
    rows = [(1, 0, 2.0, 3.0, 5.0, 9.0), (1, 1, 0.0, -2.0, 4.0, 4.0), (2, 0, 1.0, 1.0, 1.0, 5.0), (2, 1, None, 0.0, 1.0, 1.0)]
    got = {(r.scene_id, r.mask_no): r for r in N.box_runs(spark.createDataFrame(rows, "scene_id long, mask_no long, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert {k: sum(r.ends) - sum(r.starts) for k, r in got.items()} == {(1, 0): 18, (1, 1): 24, (2, 0): 0}


def test_width_without_recursion():
    assert N.matching_width(1500, [(i, i + 1) for i in range(1499)]) == 1  # a chain longer than the recursion limit
    rng = np.random.default_rng(2)
    for n in (1, 4, 7):
        for _ in range(30):
            edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
            reach = np.zeros((n, n), bool)
            for a, b in edges:
                reach[a, b] = True
            for k in range(n):
                reach |= reach[:, [k]] & reach[[k], :]
            best = max(bin(s).count("1") for s in range(1 << n) if not any(reach[a, b] for a in range(n) for b in range(n) if s >> a & 1 and s >> b & 1))
            assert N.matching_width(n, edges) == best


def test_many_boxes_at_once():
    """from_boxes, depths and Flat against the algebra of single masks; frames with negative places and a notch."""
    rng = np.random.default_rng(5)
    for h in (9, 30):
        box = rng.integers(-3, 9, (60, 4))
        box[:, 2:] += 1
        box[:5] = [[0, 0, 4, h]] * 5  # columns that touch
        notch = np.maximum(box[:, 2:] - box[:, :2], 0) // 2
        for cut in (None, notch):
            n, a, b = U.from_boxes(box, h, cut)
            flat = U.Flat(n, a, b)
            want = [U.from_box(tuple(x), h) for x in box.tolist()]
            if cut is not None:
                want = [U.minus(m, U.from_box((x[2] - d[0], x[1], x[2], x[1] + d[1]), h)) if min(d) > 0 else m for m, x, d in zip(want, box.tolist(), notch.tolist())]
            own = [flat.one(j) for j in range(len(box))]
            assert all(U.area(m) == U.area(U.covered([m], 1)) and np.array_equal(U.covered([m], 1), U.covered([w], 1)) for m, w in zip(own, want))
            assert U.depths(a, b) == (U.area(U.covered(own, 1)), U.area(U.covered(own, 2)))
            i, k = (x.ravel() for x in np.indices((60, 60)))
            some = (flat.area[i] > 0) & (flat.area[k] > 0)
            i, k = i[some], k[some]
            assert flat.shared(i, k).tolist() == [U.area(U.covered([own[x], own[y]], 2)) if x != y else U.area(own[x]) for x, y in zip(i, k)]


def test_shapes_are_made_where_they_are_needed(spark, sf):
    """No run leaves a kernel: the masks of the queries travel as boxes, once after the view; pairs in slices give the same rows."""
    from matchloom.plans.catalog import QUERIES

    for name in ("mask_nesting", "mask_overlaps", "mask_crossings", "mask_redundancy"):
        assert "array<" not in QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().treeString().lower() and "starts" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    masks, rng = {s: random_masks(np.random.default_rng(s), 14, 16, 18) for s in range(3)}, K.AT_ONCE
    df = frame(spark, {s: [U.from_rle(X.rle_encode(m)) for m in v] for s, v in masks.items()})
    want = sorted(K.shared(df).collect())
    solved = []
    plain, K.per_group = K.per_group, lambda d, key, solve, schema: solved.append(solve) or plain(d, key, solve, schema)
    try:
        K.AT_ONCE = 20
        K.shared(df)
        x = {"scene_id": np.full(16, 1), "mask_no": np.arange(16), **{c: np.array([*[U.from_rle(X.rle_encode(m))[e] for m in masks[1]], None], object)[:16] for e, c in enumerate(("starts", "ends"))}}
        got = solved[0](x)
        assert sorted(zip(*(got[c].tolist() for c in ("i", "k", "v")))) == [(r.i, r.k, r.v) for r in want if r.scene_id == 1]
    finally:
        K.AT_ONCE, K.per_group = rng, plain


def test_a_size_of_box_is_encoded_once():
    import pyarrow as pa

    from matchloom.plans.catalog_misc import rle_boxes

    seen = []
    box = [(0.0, 0.0, 3.0, 2.0), (5.0, 1.0, 8.0, 3.0), (0.0, 0.0, 2.0, 3.0)] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(range(150)), *(pa.array([b[j] for b in box]) for j in range(4))], ["scene_id", "mask_no", "x0", "y0", "x1", "y1"])
    out = list(rle_boxes(lambda m: seen.append(m.shape) or X.rle_encode(m))(iter([batch, batch])))
    assert sorted(seen) == [(4, 5), (5, 4)] and all(b.column(2).to_pylist() == [6] * 150 and all(b.column(3).to_pylist()) for b in out)
