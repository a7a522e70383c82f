"""Modelling on ``pyspark.ml``: algorithms, modes, experiment grid, scoring.

The feature table is built once per (feature set, targets) and cached while
several estimators are fitted on it.  Linear per-city models use grouped
normal equations: one ``groupBy(city)`` aggregate of cross-products, then a
k x k solve per city in ``applyInPandas`` (only k^2 numbers per city reach
Python).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airshed.constants import MODES, MULTI_TARGETS
from airshed.functions.aqi import aqi_strict, category
from airshed.operators import features as FE
from airshed.operators import split as SP


# ------------------------------------------------------------- algorithms
def label_std(df: DataFrame, label: str) -> float:
    """Population std of the label (a fitted scalar) used to map sklearn penalties onto Spark's."""
    v = df.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
    return float(v["s"] or 0.0), int(v["n"] or 0)


ALGORITHMS: dict = {}


def register_algorithm(name: str):
    """Add an algorithm: ``builder(label, n_rows, sigma_y, **common) -> estimator``."""
    def deco(builder):
        ALGORITHMS[name] = builder
        return builder
    return deco


# sklearn-equivalent settings.  Spark scales the label by its deviation before penalising, so an
# L2 penalty is multiplied by sigma_y.
@register_algorithm("Ridge")
def _ridge(label, n_rows, sigma_y, **common):
    return LinearRegression(regParam=1.0 * sigma_y / max(n_rows, 1), elasticNetParam=0.0, standardization=False,
                            solver="normal", **common)


@register_algorithm("Lasso")
def _lasso(label, n_rows, sigma_y, **common):
    return LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False, maxIter=200, **common)


@register_algorithm("ElasticNet")
def _elastic_net(label, n_rows, sigma_y, **common):
    alpha, l1 = 1.0, 0.5
    lam1, lam2 = alpha * l1, alpha * (1 - l1) * sigma_y
    return LinearRegression(regParam=lam1 + lam2, elasticNetParam=lam1 / (lam1 + lam2), standardization=False,
                            maxIter=200, **common)


@register_algorithm("RandomForest")
def _random_forest(label, n_rows, sigma_y, **common):
    return RandomForestRegressor(numTrees=100, maxDepth=15, seed=42, **common)


@register_algorithm("GradientBoosting")
def _gradient_boosting(label, n_rows, sigma_y, **common):
    return GBTRegressor(maxIter=200, maxDepth=5, seed=42, **common)


LINEAR = ["Ridge", "Lasso", "ElasticNet"]


def make_estimator(name: str, label: str, n_rows: int, sigma_y: float):
    """A registered algorithm at its default settings."""
    return ALGORITHMS[name](label, n_rows, sigma_y, featuresCol="features", labelCol=label, predictionCol="prediction")


def feature_pipeline(feature_cols: list[str], estimator) -> Pipeline:
    imputed = [f"{c}__imp" for c in feature_cols]
    return Pipeline(stages=[
        Imputer(inputCols=feature_cols, outputCols=imputed, strategy="median"),
        VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep"),
        estimator,
    ])


def as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# ----------------------------------------------------------------- modes
@dataclass(frozen=True)
class Mode:
    code: str
    scope: str      # global | city
    history: str    # today | hist
    targets: str    # multi | separate

    @property
    def experiment(self) -> str:
        return "weather" if self.history == "today" else "full"

    @property
    def horizon(self) -> int:
        return 0 if self.history == "today" else 1

    @property
    def target_list(self) -> list[str]:
        return list(MULTI_TARGETS) if self.targets == "multi" else ["pm25"]


MODE_TABLE = {m[0]: Mode(*m) for m in MODES}


def mode_rows():
    return [(m.code, m.scope, m.history, m.targets, m.experiment, m.horizon, ",".join(m.target_list))
            for m in MODE_TABLE.values()]


# ----------------------------------------------------------- experiments
def evaluate(pred: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Metrics on the original scale: expm1 of the log prediction, floored at 0."""
    p = pred.select(*keys, F.col(target).alias("_y"),
                    F.greatest(F.expm1(F.col("prediction")), F.lit(0.0)).alias("_p"))
    e = F.col("_y") - F.col("_p")
    g = p.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                             F.sum(e * e).alias("_sse"), F.var_pop("_y").alias("_v"), F.count("*").alias("_n"))
    return g.select(*keys, "rmse", "mae", (F.lit(1.0) - F.col("_sse") / (F.col("_v") * F.col("_n"))).alias("r2"))


def run_experiment(feats: DataFrame, mode: Mode, algorithm: str, target: str) -> dict:
    """Fit on the chronological train split of ``feats`` and score val/test (global scope)."""
    feature_cols = FE.feature_columns(mode.experiment, mode.target_list)
    split = SP.chrono_split(feats)
    label = f"{target}_log"
    train = split.where(F.col("split") == "train")
    sigma, n = label_std(train, label)
    est = make_estimator(algorithm, label, n, sigma)
    model = feature_pipeline(feature_cols, est).fit(train)
    scored = model.transform(split.where(F.col("split") != "train"))
    m = evaluate(scored, target, ["split"]).collect()  # two rows: val, test
    out = {"mode": mode.code, "algorithm": algorithm, "target": target}
    for r in m:
        for k in ("rmse", "mae", "r2"):
            out[f"{r['split']}_{k}"] = float(r[k]) if r[k] is not None else None
    return out


def experiment_grid(merged: DataFrame, modes: list[str], algorithms: list[str]) -> pd.DataFrame:
    """Global modes x algorithms (x targets).  A failed fit is recorded in ``error``; if every fit
    fails, that is raised.  The feature table of a mode is cached across its algorithms and
    released afterwards."""
    rows = []
    for code in modes:
        mode = MODE_TABLE[code]
        feats = FE.build_features(merged, mode.experiment, mode.target_list, horizon=mode.horizon)
        feats = as_double(feats, FE.feature_columns(mode.experiment, mode.target_list)).cache()
        try:
            for target in mode.target_list:
                for algo in algorithms:
                    try:
                        rows.append(run_experiment(feats, mode, algo, target))
                    except Exception as e:  # recorded as a failed experiment
                        rows.append({"mode": code, "algorithm": algo, "target": target, "error": str(e)[:200]})
        finally:
            feats.unpersist()
    if rows and all("error" in r for r in rows):
        raise RuntimeError(f"every experiment failed, the first with: {rows[0]['error']}")
    return pd.DataFrame(rows)


# --------------------------------------------- grouped normal equations
def city_split(feats: DataFrame, key: str = "city_name", date: str = "date") -> DataFrame:
    """Chronological split of each city's rows: 70 % train, the rest halved (a city's rows are bounded by the calendar)."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy(date)) - 1
    cut = F.floor(n * F.lit(0.7))
    return feats.withColumn("split", F.when(pos < cut, "train").when(pos < cut + F.floor((n - cut) * F.lit(0.5)), "val").otherwise("test"))


def city_ridge(feats: DataFrame, feature_cols: list[str], label: str, alpha: float = 1.0,
               key: str = "city_name") -> DataFrame:
    """Per-city ridge with intercept (not penalised): key, n, medians, intercept, coefficients.

    NULL features are the city's median over these rows (0 where it has none); cross-products are
    sums of deviations from the city's means, so large levels cost no digits.  Only k^2 numbers
    per city reach Python."""
    d = feats.where(F.col(label).isNotNull()).select(key, *[F.col(c).cast("double").alias(c) for c in feature_cols],
                                                     F.col(label).cast("double").alias("_y"))
    k = len(feature_cols)
    # a city's rows are bounded by the calendar, and so is this exact median's buffer
    med = d.groupBy(key).agg(F.array(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)) for c in feature_cols]).alias("medians"))
    d = d.join(med, key).select(key, "medians", "_y", *[F.coalesce(F.col(c), F.col("medians")[i]).alias(c) for i, c in enumerate(feature_cols)])
    means = d.groupBy(key).agg(F.avg("_y").alias("_my"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(feature_cols)])
    d = d.join(means, key)
    dev = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(feature_cols)]
    y = F.col("_y") - F.col("_my")
    stats = d.groupBy(key, "_my", *[f"_m{i}" for i in range(k)]).agg(
        F.count("*").alias("n"), F.first("medians").alias("medians"),
        F.array(*[F.sum(dev[i] * y) for i in range(k)]).alias("_xy"),
        F.array(*[F.sum(dev[i] * dev[j]) for i in range(k) for j in range(i, k)]).alias("_xx"))
    stats = stats.select(key, "n", "medians", "_my", F.array(*[f"_m{i}" for i in range(k)]).alias("_mx"), "_xy", "_xx")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False, name=None):
            name, n, medians, my, mx, xy, xx = r
            sxx = np.zeros((k, k))
            sxx[np.triu_indices(k)] = xx
            sxx = sxx + np.triu(sxx, 1).T
            w = np.linalg.solve(sxx + alpha * np.eye(k), np.asarray(xy, float))
            out.append((name, int(n), list(medians), float(my - np.asarray(mx, float) @ w), [float(x) for x in w]))
        return pd.DataFrame(out, columns=[key, "n", "medians", "intercept", "coefficients"])

    return stats.groupBy(key).applyInPandas(solve, f"{key} string, n long, medians array<double>, intercept double, coefficients array<double>")


def city_predict(feats: DataFrame, models: DataFrame, feature_cols: list[str], key: str = "city_name") -> DataFrame:
    """``feats`` with the prediction of each row's own city model."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.col("medians")[i]) for i, c in enumerate(feature_cols)])
    dot = F.aggregate(F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    m = models.select(key, "medians", "intercept", "coefficients")
    return feats.join(m, key).withColumn("prediction", F.col("intercept") + dot).drop("medians", "intercept", "coefficients")


def city_experiment(merged: DataFrame, mode: Mode, target: str, alpha: float = 1.0) -> DataFrame:
    """One ridge per eligible city (100 rows and targets at least), fitted on its own train split
    with medians learnt there: val and test metrics of every city, all cities in a few aggregates."""
    cols = FE.feature_columns(mode.experiment, mode.target_list)
    feats = as_double(FE.build_features(merged, mode.experiment, mode.target_list, horizon=mode.horizon), cols)
    enough = SP.eligible_cities(feats, min_rows=100, min_target=100).select("city_name")
    split = city_split(feats.join(enough, "city_name", "left_semi"))
    models = city_ridge(split.where("split = 'train'"), cols, f"{target}_log", alpha)
    m = evaluate(city_predict(split.where("split <> 'train'"), models, cols), target, ["city_name", "split"])
    return m.select(F.lit(mode.code).alias("mode"), F.lit(target).alias("target"), "*")


# ---------------------------------------------------------------- scoring
def score_with_aqi(model, df: DataFrame, keys: list[str]) -> DataFrame:
    """predict -> expm1 -> predicted_pm25 -> AQI and category of the prediction."""
    return with_aqi(model.transform(df), keys)


def with_aqi(p: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions of the log target as concentration, AQI and category."""
    pred = F.greatest(F.expm1(F.col("prediction")), F.lit(0.0))
    out = p.select(*keys, pred.alias("predicted_pm25"))
    return out.select("*", aqi_strict(F.col("predicted_pm25"), "pm25").alias("predicted_aqi")) \
        .select("*", category("predicted_aqi").alias("predicted_category"))


def one_hot_train_fit(train: DataFrame, other: DataFrame, col: str) -> DataFrame:
    """Categories learnt on train (alphabetical); unseen values in ``other`` -> all-zero vector."""
    idx = StringIndexer(inputCol=col, outputCol=f"{col}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
    # the indexer's last index is the one of unseen values: dropped, it leaves them all zeros
    enc = OneHotEncoder(inputCols=[f"{col}_idx"], outputCols=[f"{col}_vec"], dropLast=True, handleInvalid="error")
    model = Pipeline(stages=[idx, enc]).fit(train)
    return model.transform(other)
