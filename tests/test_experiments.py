"""The experiment grid, its registry and the production choice, with small tree settings."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from airshed.operators import experiments as EX
from airshed.operators import features as FE
from airshed.operators import ml as ML
from airshed.plans.pipeline import stored_merged

SMALL = {"RandomForest": {"trees": 3, "depth": 4}, "GradientBoosting": {"rounds": 3, "depth": 3}}


@pytest.fixture(scope="module")
def merged(spark, sf_small):
    """A dense table of five cities and 260 days, from the stored one's columns."""
    m = stored_merged(spark, sf_small)
    cols = [f.name for f in m.schema if f.dataType.typeName() == "double"]
    days = spark.range(260).select(F.expr("date_add(DATE'1998-01-01', CAST(id AS INT))").alias("date"), F.col("id").alias("k"))
    cities = spark.createDataFrame([(f"C{i}", i) for i in range(5)], "city_name string, i int")
    base = days.join(F.broadcast(cities))
    noise = lambda c: F.pmod(F.xxhash64("k", "i", F.lit(c)), F.lit(1000)) / 1000.0
    value = lambda c: F.when(noise(c + "null") < 0.05, None).otherwise(noise(c) * 30 + 5 * F.col("i"))
    target = {"pm25": F.lit(20.0) + 15 * F.sin(F.col("k") / 9) + 3 * F.col("i") + 4 * noise("p"), "o3": F.lit(0.05) + 0.01 * noise("o")}
    extra = [c for c in m.columns if c not in ("city_name", "date", "year", *cols)]
    return base.select("city_name", "date", F.year("date").alias("year"), *[F.lit(None).cast(m.schema[c].dataType).alias(c) for c in extra],
                       *[target.get(c, value(c)).cast("double").alias(c) for c in cols]).cache()


def test_every_cell_of_the_grid(spark, merged):
    parts = [EX.linear(merged, code) for code in ML.MODE_TABLE]
    parts += [EX.city_trees(merged, code, settings=SMALL) for code in ML.MODE_TABLE if code[0] == "C"]
    parts.append(EX.global_boosting(merged, [code for code in ML.MODE_TABLE if code[0] == "G"], rounds=3, depth=3))
    path = tempfile.mkdtemp(prefix="airshed-results-")
    for k, p in enumerate(parts):
        EX.record(p, path, f"p{k}")
    rows = EX.registered(spark, path).collect()
    cells = {(r["mode"], r["algorithm"], r["target"]) for r in rows}
    # the forest of the global modes is Spark's and has its own test
    assert len(cells) == (8 * 4 + 4) * 3 // 2
    for r in rows:
        assert (r["city_name"] is None) == (r["mode"][0] == "G")
        assert r["val_rmse"] > 0 and r["test_rmse"] > 0 and r["val_r2"] <= 1 and r["test_mae"] > 0
    assert all(sum(1 for r in rows if (r["mode"], r["algorithm"], r["target"]) == c) == (1 if c[0][0] == "G" else 5) for c in cells)
    best = EX.choose(EX.registered(spark, path))
    means = {}
    for r in rows:
        if r["target"] == "pm25":
            means.setdefault((r["val_rmse"] is None, r["mode"], r["algorithm"]), []).append(r["val_rmse"])
    least = min(means, key=lambda c: (np.mean(means[c]), c))
    assert (best["mode"], best["algorithm"]) == least[1:] and best["candidates"] == len(means)
    # a new version of a part replaces the old one in the registry and leaves it in store
    EX.record(EX.registered(spark, path).where("part = 'p0'").drop("part", "version").withColumn("val_rmse", F.lit(1e-9)), path, "p0")
    again = EX.registered(spark, path).where("part = 'p0'").collect()
    assert {r["version"] for r in again} == {2} and EX.versions(spark, path, "p0") == [("p0", 1), ("p0", 2)]
    assert EX.choose(EX.registered(spark, path))["val_rmse"] == 1e-9


@pytest.mark.parametrize("code,algorithm", [("GTS", "Ridge"), ("CHS", "Lasso"), ("CTM", "GradientBoosting"), ("CTS", "RandomForest"), ("GHS", "GradientBoosting"), ("GTS", "RandomForest")])
def test_any_cell_can_go_to_production(spark, merged, code, algorithm, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor
    monkeypatch.setitem(ML.ALGORITHMS, "RandomForest", lambda label, n, s, **common: RandomForestRegressor(numTrees=3, maxDepth=3, seed=1, **common))
    path = tempfile.mkdtemp(prefix="airshed-production-")
    EX.train(merged, code, algorithm, path, settings=SMALL.get(algorithm) if code[0] == "C" or algorithm != "RandomForest" else None, manifest={"val_rmse": 1.0})
    about = EX.manifest(spark, path)
    assert (about["mode"], about["algorithm"], about["val_rmse"]) == (code, algorithm, 1.0) and about["n_train"] > 1000
    scored = EX.score(merged, path)
    assert scored.count() == about["n_train"] and scored.where("prediction IS NULL").count() == 0
    goal = merged.select("city_name", "date", F.log1p("pm25").alias("y"))
    if ML.MODE_TABLE[code].horizon == 0:
        err = scored.join(goal, ["city_name", "date"]).agg(F.avg((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y")).first()
        assert err[0] < err[1]


def test_linear_results_of_a_city_are_its_own_closed_form(spark, merged):
    mode = ML.MODE_TABLE["CTS"]
    got = {r["city_name"]: r for r in EX.linear(merged, "CTS", ("Ridge",)).collect()}
    cols = FE.feature_columns("weather", ["pm25"])
    rows, _ = EX.mode_rows(merged, mode)
    pdf = rows.select("city_name", "split", "pm25", "pm25_log", *cols).toPandas()
    for city, own in pdf.groupby("city_name"):
        train = own[own.split == "train"]
        fill = train[cols].median()
        x = train[cols].fillna(fill).to_numpy(float)
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(len(cols)), (x - x.mean(0)).T @ (train["pm25_log"] - train["pm25_log"].mean()))
        val = own[own.split == "val"]
        p = np.maximum(np.expm1((val[cols].fillna(fill).to_numpy(float) - x.mean(0)) @ w + train["pm25_log"].mean()), 0)
        assert abs(got[city]["val_rmse"] - np.sqrt(np.mean((val["pm25"] - p) ** 2))) < 1e-6


def test_rolling_validation_against_fits_by_hand(spark, merged):
    cols = FE.feature_columns("weather", ["pm25"])
    rows = ML.as_double(FE.build_features(merged, "weather", ["pm25"], horizon=0), cols)
    got = {r["fold"]: r for r in EX.rolling_validation(rows, cols, "pm25", 30).collect()}
    pdf = rows.select("date", "pm25", "pm25_log", *cols).toPandas()
    day = (np.array(pdf["date"].tolist(), "datetime64[D]") - np.datetime64("1998-01-01")).astype(int)
    x = pdf[cols].fillna(pdf.loc[day < 30, cols].median()).to_numpy(float)
    assert sorted(got) == list(range(1, 9))
    for k, r in got.items():
        past, now = day < 30 * k, day // 30 == k
        xm, ym = x[past].mean(0), pdf["pm25_log"][past].mean()
        w = np.linalg.solve((x[past] - xm).T @ (x[past] - xm) + np.eye(len(cols)), (x[past] - xm).T @ (pdf["pm25_log"][past] - ym))
        p, y = np.maximum(np.expm1((x[now] - xm) @ w + ym), 0), pdf["pm25"][now].to_numpy()
        assert (r["n_train"], r["n_test"]) == (past.sum(), now.sum())
        assert abs(r["rmse"] - np.sqrt(np.mean((y - p) ** 2))) < 1e-6 and abs(r["mae"] - np.abs(y - p).mean()) < 1e-6
    assert EX.rolling_validation(rows.limit(0), cols, "pm25").collect() == []
