"""Model operators against closed forms, and artefact round trips."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from airshed.operators import ml as ML


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for c in ("a", "b"):
        for k in range(160):
            x = [float(v) for v in rng.normal(size=2)] + [1000 + float(rng.normal())]
            y = (2.0 if c == "a" else -1.0) * x[0] + 0.5 * x[1] - 0.3 * (x[2] - 1000) + float(rng.normal()) * 0.1
            out.append((c, k, x[0], None if k % 17 == 0 else x[1], x[2], y))
    return spark.createDataFrame(out, "city_name string, k int, x0 double, x1 double, x2 double, y double").cache()


COLS = ["x0", "x1", "x2"]


def _closed_form(pdf, alpha):
    x = pdf[COLS].copy()
    x = x.fillna(x.median())
    xc, yc = x.to_numpy() - x.to_numpy().mean(0), pdf["y"].to_numpy() - pdf["y"].mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(COLS)), xc.T @ yc)
    return w, pdf["y"].mean() - x.to_numpy().mean(0) @ w


def test_ridge_pipeline_is_the_normal_equations(spark, rows):
    one = rows.where("city_name = 'a'")
    sigma, n = ML.label_std(one, "y")
    model = ML.feature_pipeline(COLS, ML.make_estimator("Ridge", "y", n, sigma)).fit(one)
    w, b = _closed_form(one.toPandas(), 1.0)
    assert np.allclose(model.stages[-1].coefficients.toArray(), w, atol=1e-3)
    assert abs(model.stages[-1].intercept - b) < 1.0


def test_city_ridge_equals_the_closed_form_and_spark(spark, rows):
    got = {r["city_name"]: r for r in ML.city_ridge(rows, COLS, "y", alpha=1.0).collect()}
    pdf = rows.toPandas()
    for c in ("a", "b"):
        w, b = _closed_form(pdf[pdf.city_name == c], 1.0)
        assert np.allclose(got[c]["coefficients"], w, atol=1e-6) and abs(got[c]["intercept"] - b) < 1e-4
    # without a penalty: LinearRegression on one city's rows (the two impute by slightly different medians, so on full columns)
    full = ["x0", "x2"]
    free = {r["city_name"]: r for r in ML.city_ridge(rows, full, "y", alpha=0.0).collect()}
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0, solver="normal")
    model = ML.feature_pipeline(full, lr).fit(rows.where("city_name = 'b'"))
    assert np.allclose(free["b"]["coefficients"], model.stages[-1].coefficients.toArray(), atol=1e-6)


def test_city_predict(spark, rows):
    models = ML.city_ridge(rows, COLS, "y")
    out = ML.city_predict(rows, models, COLS).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert out < 0.3


def test_split_is_chronological_per_city(spark, rows):
    s = ML.city_split(rows.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k"))))
    got = s.groupBy("city_name", "split").agg(F.min("k"), F.max("k")).collect()
    at = {(r[0], r[1]): (r[2], r[3]) for r in got}
    for c in ("a", "b"):
        assert at[c, "train"] == (0, 111) and at[c, "val"] == (112, 135) and at[c, "test"] == (136, 159)


def test_default_settings_and_registration():
    assert ML.make_estimator("RandomForest", "y", 0, 0.0).getNumTrees() == 100
    assert ML.make_estimator("RandomForest", "y", 0, 0.0).getMaxDepth() == 15
    assert ML.make_estimator("GradientBoosting", "y", 0, 0.0).getMaxIter() == 200
    ML.register_algorithm("Plain")(lambda label, n, s, **common: LinearRegression(regParam=0.0, **common))
    try:
        assert ML.make_estimator("Plain", "y", 1, 1.0).getRegParam() == 0.0
    finally:
        del ML.ALGORITHMS["Plain"]


def test_artefact_round_trip(spark, rows):
    model = ML.feature_pipeline(COLS, ML.make_estimator("Ridge", "y", 160, 1.0)).fit(rows)
    path = tempfile.mkdtemp(prefix="airshed-model-") + "/m"
    model.write().save(path)
    a = [r[0] for r in model.transform(rows).select("prediction").collect()]
    assert a == [r[0] for r in PipelineModel.load(path).transform(rows).select("prediction").collect()]


def test_grid_reports_failures(spark, monkeypatch):
    monkeypatch.setattr(ML.FE, "build_features", lambda *a, **k: spark.createDataFrame([], "city_name string"))
    monkeypatch.setattr(ML, "as_double", lambda df, cols: df)
    with pytest.raises(RuntimeError, match="every experiment failed"):
        ML.experiment_grid(None, ["GTS"], ["Ridge"])
