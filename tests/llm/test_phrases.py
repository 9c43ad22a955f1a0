"""Mined phrases against a plain count of all n-grams."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from matchloom.llm import phrases as P
from matchloom.llm.queries import OP13_SQL, op13_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, first=2000, support=30, longest=4, unit=2_000_000, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {}
    for p, a in f.items():
        if len(p) > 2 and a >= support:
            sides = [(unit * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(sides)
            cand[p] = (a, f[p[: k + 1]], f[(p[0], *p[k + 1 :])], score)
    gone = set()
    for p in cand:
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                if 100 * cand[p][0] >= inside * cand[q][0]:
                    gone.add(q)
    out = []
    for lang in n:
        own = sorted(((" ".join(p[1:]), v) for p, v in cand.items() if p[0] == lang and p not in gone), key=lambda x: (-x[1][3], -x[1][0], x[0].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (p, (a, l, r, s)) in enumerate(own[:first])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n long, phrase string").repartition(4)
    return sorted(map(tuple, P.mine(df, **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocab = ["The", "cat", "sat\ton", "new  york,", "city.", "é x", "ÇA", "a", "a", "b\n", "q;r", "<x>"]
    out = [(" ".join(rng.choice(vocab, rng.integers(0, 40)).tolist()), ["en", "de", None, "und", ""][i % 5]) for i in range(150)]
    out += [("of the new york city hall", "en")] * 90 + [("the new york", "en")] * 12
    return out + [(None, "en"), ("", None), (" .\x0b,\t ", "en"), ("a " * 3000, "fr"), ("x" * 9000, "fr"), (None, "zz")]


@pytest.mark.parametrize("kw", [{}, {"support": 3, "first": 40}, {"support": 1, "first": 7, "longest": 3}, {"support": 200, "inside": 50}])
def test_against_plain(spark, rows, kw):
    assert mined(spark, rows, **kw) == plain(rows, **kw)


def test_full_buckets_change_nothing(spark, rows, monkeypatch):
    want = mined(spark, rows, support=4)
    monkeypatch.setattr(P, "SLICE", 300)
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(P, "MOST_FREQUENT", 16)
    assert mined(spark, rows, support=4, buckets=16) == want == plain(rows, support=4)


def test_equal_hashes_do_not_mix(spark, rows, monkeypatch):
    import pyarrow as pa

    raw = np.frombuffer(b"a b a c b a a b", np.uint8)
    s = P.Slice(raw, np.array([0, 7, len(raw)]), np.array([1, 2]))
    row, phrases, counts = s.counted(np.arange(s.words.n), 1, np.zeros(s.words.n, np.uint64), np.array([0, 1]))
    total = Counter()
    for r, p, c in zip(row.tolist(), pa.array(phrases).to_pylist(), counts.tolist()):
        total[r, p] += c
    assert total == {(0, "a"): 2, (0, "b"): 1, (0, "c"): 1, (1, "a"): 2, (1, "b"): 2}


def test_bucket_counts_stop_before_they_wrap():
    c = P.Counter(16)
    one = np.uint64(7) << np.uint64(48)
    for n in (10, 40_000, 200_000, 70_000):
        c.add(np.full(n, one))
        c.add(np.arange(0, 1 << 16, dtype=np.uint64) << np.uint64(48))
    assert c.counts[7] == c.MOST and set(np.delete(c.counts, 7).tolist()) == {4}
    (block, sparse, data), = c.blocks()
    assert (block, sparse, len(data)) == (0, False, 1 << 16) and data[7] == 255 and data[8] == 4


def test_empty_and_limits(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []
    with pytest.raises(ValueError):
        mined(spark, [], support=256)


def test_scores_are_exact(spark):
    big = 10**16
    df = spark.createDataFrame([("en", "x", 1, 3 * big), ("en", "y", 1, 2 * big), ("en", "x y", 2, big + 1)], "lang string, phrase string, words int, a long")
    r = P.score_cuts(df).collect()[0]
    assert (r.l, r.r, r.score) == (3 * big, 2 * big, 2_000_000 * (big + 1) // (5 * big))


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(OP13_SQL)
    names = [d[0] for d in cur.description]
    got = sorted(map(tuple, op13_phrases(spark, sf).select(*names).collect()))
    assert sorted(cur.fetchall()) == got and len(got) > 40
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_phrases(spark, sf).collect())) == plain(docs)
