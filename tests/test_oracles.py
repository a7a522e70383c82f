"""Every registered query with a SQL oracle matches DuckDB on the smallest scale factor."""

import pytest

from harness import compare, duck_connect, type_mismatches

from airshed.plans.registry import ORACLES, QUERIES, load_all

load_all()
#: Full-strength boosting and forests take minutes; test_experiments.py runs their functions at small settings, with values.
SLOW_ROWS_ONLY = {"experiment_boosting", "experiment_boosting_city", "experiment_forest", "experiment_forest_city", "city_tree_models"}


@pytest.fixture(scope="module")
def con(sf_small):
    return duck_connect(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg
    assert not type_mismatches(df, con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and n not in SLOW_ROWS_ONLY))
def test_rows_only_queries_give_values(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    for r in rows:
        assert r.get("error") is None
    for c, kind in df.dtypes:
        values = [r[c] for r in rows if r[c] is not None]
        assert values or c in ("error", "improves_2pct", "watermark"), c
        if "rmse" in c or "mae" in c:
            # the smallest scale factor leaves some city modes without an eligible city
            assert all(v > 0 for v in values) and all(r[c] is not None for r in rows if r.get("mode", "G")[0] == "G"), c
        if c.endswith("r2") or c == "importance":
            assert all(v <= 1 for v in values), c


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
