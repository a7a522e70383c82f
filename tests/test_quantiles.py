"""Exact quantiles of many groups, hot ones by range buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airshed.operators import eda as E

PROBS = [0.02, 0.25, 0.5, 0.98]


def test_group_quantiles_match_numpy_on_either_way(spark):
    rnd = random.Random(9)
    rows = [("hot", rnd.choice([1.5, 1.5, rnd.gauss(0, 9)])) for _ in range(3000)] + [("hot", None)]
    rows += [(f"g{rnd.randrange(40)}", rnd.gauss(0, 1)) for _ in range(600)] + [("one", 2.0), ("none", None)]
    rows += [(None, float(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").select(F.struct("k").alias("g"), "v")
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    for large in (100, 10_000, 0):
        got = {r.g.k: r.q for r in E.group_quantiles(df, "g", "v", PROBS, large).collect()}
        assert got.keys() == want.keys()
        for k, q in got.items():
            assert q == pytest.approx(np.quantile(want[k], PROBS), abs=1e-9)
    assert E.group_quantiles(df.where(F.lit(False)), "g", "v", PROBS).count() == 0


def test_aggregates_come_with_the_quantiles_and_no_crowd_means_one_exchange(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.gauss(0, 1)) for _ in range(500)] + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").select(F.struct("k").alias("g"), "v")
    also = [F.count("v").alias("n"), F.max("v").alias("top")]
    for large in (10_000, 50):
        got = {r.g.k: r for r in E.group_quantiles(df, "g", "v", PROBS, large, also).collect()}
        for k in "abc":
            own = [v for a, v in rows if a == k and v is not None]
            assert got[k].n == len(own) and got[k].top == max(own) and got[k].q == pytest.approx(np.quantile(own, PROBS), abs=1e-9)
    plan = E.group_quantiles(df, "g", "v", PROBS, also=also)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
