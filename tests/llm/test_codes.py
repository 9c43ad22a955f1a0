"""Codes and codebooks against plain loops in Python integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from matchloom.llm import codes as C
from matchloom.llm.queries import OP11_SQL, op11_codes


def plain(rows, parts, entries, rounds, scale):
    """{place: (code, error)}, codebooks; rows are (id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max((len(x) for _, x in kept), default=0) // parts) * parts
    w = dim // parts
    cut = [[(x + [0] * dim)[p * w : (p + 1) * w] for p in range(parts)] for _, x in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda p, y: min((dist(y, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for x in cut:
                own[find(p, x[p])[1]].append(x[p])
            new.append([[sum(z) // len(m) for z in zip(*m)] if m else e for m, e in zip(own, books[p])])
        books = new
    found = [[find(p, x[p]) for p in range(parts)] for x in cut]
    return [(i, bytes(j for _, j in f).hex(), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)], books


ROWS = [(None, [0.5] * 10), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan")] * 10), (6, [float("inf"), 1.0]), (7, [0.25, -0.25, 1.0]), (7, [9.0]), (8, [])]


@pytest.mark.parametrize("parts, entries, rounds", [(4, 5, 3), (8, 16, 6), (3, 40, 2)])
def test_against_plain(spark, parts, entries, rounds):
    rng = np.random.default_rng(parts)
    centre = rng.integers(-3, 4, (6, 10))
    rows = ROWS + [(100 + i, (centre[rng.integers(6)] + rng.integers(-2, 3, 10) / 8).tolist()) for i in range(90)] + [(300, [1.0] * 10)] * 30
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, code string, error int").repartition(5)
    books = C.train(df, parts, entries, rounds, 64)
    want, want_books = plain(rows, parts, entries, rounds, 64)
    assert books.entries.tolist() == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()
    got = [(r.vec_id, bytes(r.code).hex(), r.error) for r in C.encode(df, books, ["vec_id", "code"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = C.decode(C.encode(df.filter("vec_id = 300"), books, ["vec_id"]), books, ["vec_id"]).collect()
    assert len(back) == 30 and len(back[0].embedding) == books.dim


def test_tree_visits_ties_and_leaves_sides_out():
    rng = np.random.default_rng(0)
    for n, w, spread in ((1, 2, 5), (4, 3, 3), (16, 8, 1000), (64, 2, 4), (256, 1, 3000), (200, 4, 1 << 28)):
        book = rng.integers(-spread, spread + 1, (n, w))
        x = np.concatenate([rng.integers(-spread, spread + 1, (300, w)), book])
        which, best = C.Tree(book).nearest(x)
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in book] for q in x], dtype=object)
        assert best.tolist() == d.min(axis=1).tolist() and which.tolist() == d.argmin(axis=1).tolist()


def test_tree_skips_far_sides(monkeypatch):
    book = np.arange(64)[:, None] * 1000
    seen = []
    plain_squared = C.squared
    monkeypatch.setattr(C, "squared", lambda x, e: seen.append(len(x)) or plain_squared(x, e))
    tree = C.Tree(book)
    seen.clear()
    tree.nearest(np.arange(0, 63_000, 37)[:, None])
    assert sum(seen) < 0.4 * 64 * len(range(0, 63_000, 37))


def test_range_and_empty(spark):
    ddl = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError, match="too large"):
        C.train(spark.createDataFrame([(0, [1e20]), (1, [0.0])], ddl))
    with pytest.raises(ValueError, match="too large"):
        C.train(spark.createDataFrame([(0, [1e308, 1.0])], ddl))
    for rows in ([], [(1, None)], [(1, [float("nan")])]):
        df = spark.createDataFrame(rows, ddl)
        books = C.train(df)
        assert books.entries.shape[1] == 0 and C.encode(df, books, ["vec_id"]).collect() == []
    df = spark.createDataFrame([(1, [])], ddl)
    assert [(r.vec_id, r.error) for r in C.encode(df, C.train(df), ["vec_id"]).collect()] == [(1, 0)]


def test_group_errors(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 1, 7), (4, 2, 8), (5, 1, 1)], "vec_id long, label int, error long")
    assert sorted((r.vec_id, r.total) for r in C.with_group_error(df, "label", "total").collect()) == [(1, 11), (2, 11), (3, 8), (4, 8), (5, 8)]


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(OP11_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(map(tuple, op11_codes(spark, sf).select(*names).collect()))
