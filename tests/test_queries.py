"""Every registered core query with SQL equals DuckDB at sf0.001."""

import math

import duckdb
import pytest

from matchloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str([norm(r[i]) for i in at]) for r in cur.fetchall())
    assert sorted(str([norm(v) for v in r]) for r in df.select(*cols).collect()) == want


#: Queries without SQL, and the tests that hold them against brute force.
BY_TEST = {
    "nest_width": "test_width_against_brute_force", "lsh_recall": "test_lsh_grows_with_the_gallery", "graph_recall": "test_graphs_against_brute_force", "boot_weights_seeded": "test_draws_equal_numpy", "gallery_chains_seeded": "test_draws_equal_numpy",
    "debias_project": "test_debias_against_brute_force", "boot_ap_ci": "test_boot_ap_over_weight_vectors", "paired_ap_diff": "test_paired_ap_by_subset", "verdict_rejection": "test_growth_rules_on_a_fixture", "growth_rules": "test_growth_rules_on_a_fixture", "growth_rules_verdict": "test_growth_rules_on_a_fixture",
}


def test_every_query_has_sql_or_a_test():
    import test_operators

    assert set(QUERIES) - set(ORACLES) == set(BY_TEST) and all(hasattr(test_operators, t) for t in BY_TEST.values())


def test_lsh_recall_is_high(spark, sf):
    r = QUERIES["lsh_recall"](spark, sf).collect()[0]
    assert r.recall >= 0.9 and r.same_label <= r.recall


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_graph_recall_is_high(spark, size):
    r = QUERIES["graph_recall"](spark, f"/root/testdata/sf{size}").collect()[0]
    assert r.recall >= 0.95 and r.same_label <= r.recall and r.shared >= 0.9 and r.n > 0
