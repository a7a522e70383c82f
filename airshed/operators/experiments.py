"""The experiment grid: eight modes x five algorithms (x cities x targets), and the production choice.

A mode's rows are split once.  Linear algorithms come from one Gram aggregate for all its groups
and targets; trees of city modes are fitted by city in one job; boosting of the global modes grows
all their models in step; forests of the global modes grow over the distributed rows (``forest``).  Results are one table, with a
row for every mode, algorithm, target and city (null: all rows together).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.operators import features as FE
from airshed.operators import forest as FO
from airshed.operators import gram as G
from airshed.operators import ml as ML
from airshed.operators import split as SP
from airshed.operators import trees as T
from airshed.session import checkpoint_dir

RESULTS = ("mode string, algorithm string, target string, city_name string, val_rmse double, val_mae double, val_r2 double, "
           "test_rmse double, test_mae double, test_r2 double")
ALL = "all"


def mode_rows(merged: DataFrame, mode: ML.Mode, split: bool = True) -> tuple[DataFrame, list[str]]:
    """Features of a mode with ``group`` (the city, or 'all') and split, and the feature columns.  City modes keep
    cities with 100 rows and targets, split by themselves; NULL features stay."""
    cols = FE.feature_columns(mode.experiment, mode.target_list)
    feats = ML.as_double(FE.build_features(merged, mode.experiment, mode.target_list, horizon=mode.horizon), cols)
    if mode.scope == "city":
        feats = feats.join(SP.eligible_cities(feats, min_rows=100, min_target=100).select("city_name"), "city_name", "left_semi")
        feats = feats.withColumn("group", F.col("city_name"))
        return (ML.city_split(feats) if split else feats.withColumn("split", F.lit("train"))), cols
    feats = feats.withColumn("group", F.lit(ALL))
    return (SP.chrono_split(feats) if split else feats.withColumn("split", F.lit("train"))), cols


def filled(rows: DataFrame, cols: list[str], mode: ML.Mode) -> DataFrame:
    """NULL features as the medians of the train rows, of each city in city modes."""
    return G.impute_by(rows, cols, "group" if mode.scope == "city" else None, rows.where("split = 'train'"))


def labels(mode: ML.Mode) -> list[str]:
    return [f"{t}_log" for t in mode.target_list]


def _actual(mode: ML.Mode):
    c = F.lit(None).cast("double")
    for t in mode.target_list:
        c = F.when(F.col("target") == f"{t}_log", F.col(t)).otherwise(c)
    return c


def _results(predicted: DataFrame, mode: ML.Mode) -> DataFrame:
    """Rows as in RESULTS of (group, algorithm, target, split, prediction, and the targets themselves)."""
    p = predicted.withColumn("_actual", _actual(mode))
    m = ML.evaluate(p, "_actual", ["group", "algorithm", "target", "split"])
    wide = m.groupBy("group", "algorithm", "target").agg(*[F.max(F.when(F.col("split") == s, F.col(k))).alias(f"{s}_{k}") for s in ("val", "test") for k in ("rmse", "mae", "r2")])
    city = F.col("group") if mode.scope == "city" else F.lit(None).cast("string")
    return wide.select(F.lit(mode.code).alias("mode"), "algorithm", F.regexp_replace("target", "_log$", "").alias("target"), city.alias("city_name"),
                       *[f"{s}_{k}" for s in ("val", "test") for k in ("rmse", "mae", "r2")])


def linear(merged: DataFrame, code: str, algorithms=tuple(G.LINEAR)) -> DataFrame:
    """Results of the linear algorithms in one mode."""
    mode = ML.MODE_TABLE[code]
    rows, cols = mode_rows(merged, mode)
    rows = filled(rows, cols, mode).cache()
    models = G.fit(rows.where("split = 'train'"), "group", cols, labels(mode), algorithms).drop("n")
    models = models if mode.scope == "city" else F.broadcast(models)  # of one group: algorithms x targets rows
    out = _results(G.predict(rows.where("split <> 'train'").join(models, "group"), cols), mode).checkpoint()
    rows.unpersist()
    return out


def city_trees(merged: DataFrame, code: str, algorithms=tuple(T.FITS), settings: dict | None = None) -> DataFrame:
    """Results of the tree algorithms in a city mode: all cities and targets in one job."""
    mode = ML.MODE_TABLE[code]
    rows, cols = mode_rows(merged, mode)
    p = T.fit_groups(rows, "group", ["date", *mode.target_list], cols, labels(mode), algorithms, settings)
    return _results(p, mode)


def global_boosting(merged: DataFrame, codes: list[str], **settings) -> DataFrame:
    """Results of boosting in the global modes: all their models grow in step on the distributed rows."""
    every, fits, tables = None, {}, {}
    for code in codes:
        mode = ML.MODE_TABLE[code]
        rows, cols = mode_rows(merged, mode)
        tables[code] = rows
        train = rows.where("split = 'train'").select(*cols, *[F.col(y).alias(f"{code}|{y}") for y in labels(mode)])
        every = train if every is None else every.unionByName(train, allowMissingColumns=True)
        fits |= {f"{code}|{y}": (cols, f"`{code}|{y}`") for y in labels(mode)}
    models = T.boost_distributed(every, fits, **{**T.BOOST, **settings})
    out = None
    for name, model in models.items():
        code, y = name.split("|")
        p = T.predict_with(tables[code].where("split <> 'train'"), model, fits[name][0])
        r = _results(p.withColumns({"algorithm": F.lit("GradientBoosting"), "target": F.lit(y)}), ML.MODE_TABLE[code])
        out = r if out is None else out.unionByName(r)
    return out


def global_forest(merged: DataFrame, codes: list[str], **settings) -> DataFrame:
    """Results of the random forest in the global modes."""
    out = None
    for code in codes:
        mode = ML.MODE_TABLE[code]
        rows, cols = mode_rows(merged, mode)
        known = [f"{c}__imp" for c in cols]
        rows = rows.cache()
        full = Imputer(inputCols=cols, outputCols=known, strategy="median").fit(rows.where("split = 'train'")).transform(rows)
        p = FO.predictions(full, ["city_name", "date"], ["group", *mode.target_list], known, labels(mode), **{**FO.FOREST, **settings})
        r = _results(p.withColumn("algorithm", F.lit("RandomForest")), mode).checkpoint()
        rows.unpersist()
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- the result registry


def record(results: DataFrame, path: str, part: str) -> DataFrame:
    """Store a part of the grid as a new version under ``path``; earlier versions stay.  Returns the stored rows."""
    spark = results.sparkSession
    version = max([v for _, v in versions(spark, path, part)], default=0) + 1
    results.write.mode("errorifexists").parquet(f"{path}/{part}/v{version:06d}")
    return spark.read.schema(RESULTS).parquet(f"{path}/{part}/v{version:06d}")


def versions(spark: SparkSession, path: str, part: str | None = None) -> list[tuple[str, int]]:
    """(part, version) of every finished result table under ``path`` (a version without its success marker is unfinished)."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for p in fs.listStatus(root) if fs.exists(root) else []:
        name = p.getPath().getName()
        for v in fs.listStatus(p.getPath()) if part in (None, name) else []:
            if fs.exists(jvm(f"{v.getPath()}/_SUCCESS")):
                out.append((name, int(v.getPath().getName()[1:])))
    return sorted(out)


def registered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every part's newest version, with part and version."""
    newest = dict(versions(spark, path))
    out = spark.createDataFrame([], f"{RESULTS}, part string, version int")
    for part, v in newest.items():
        out = out.unionByName(spark.read.schema(RESULTS).parquet(f"{path}/{part}/v{v:06d}").withColumns({"part": F.lit(part), "version": F.lit(v)}))
    return out


def choose(results: DataFrame, target: str = "pm25", by: str = "val_rmse") -> dict:
    """The mode and algorithm with the least mean ``by`` (over a city mode's cities); ties by name.  At most 40 rows reach the driver."""
    ranked = results.where((F.col("target") == target) & F.col(by).isNotNull()).groupBy("mode", "algorithm").agg(F.avg(by).alias(by), F.count(F.lit(1)).alias("models"))
    best = ranked.orderBy(by, "mode", "algorithm").first()
    if best is None:
        raise ValueError(f"no results for {target}")
    return {**best.asDict(), "candidates": ranked.count()}


# ---------------------------------------------------------------- production


def train(merged: DataFrame, code: str, algorithm: str, path: str, target: str = "pm25", settings: dict | None = None, manifest: dict | None = None) -> None:
    """Fit a mode and algorithm on all rows and save model and manifest under ``path``: a table with one model
    for each group, or a PipelineModel for the global forest."""
    spark, mode, y = merged.sparkSession, ML.MODE_TABLE[code], f"{target}_log"
    rows, cols = mode_rows(merged, mode, split=False)
    settings = settings or {}
    if algorithm in G.LINEAR:
        medians = rows.groupBy("group").agg(F.array(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)) for c in cols]).alias("medians")) if mode.scope == "city" else None
        full = filled(rows, cols, mode)
        models = G.fit(full, "group", cols, [y], (algorithm,))
        if medians is None:
            one = {r["variable"]: r["q"][0] for r in _medians(rows, cols).collect()}  # a row for each feature
            medians = spark.range(1).select(F.lit(ALL).alias("group"), F.array(*[F.lit(float(one.get(c) or 0.0)) for c in cols]).alias("medians"))
        models.join(medians, "group").write.mode("overwrite").parquet(f"{path}/model")
    elif mode.scope == "city":
        make, default = T.FITS[algorithm]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            use = frame[y].notna()
            model = make(frame.loc[use, cols].to_numpy(float), frame.loc[use, y].to_numpy(float), **{**default, **settings})
            return pd.DataFrame([(frame["group"].iloc[0], T.to_json(model))], columns=["group", "model"])

        rows.select("group", y, *cols).groupBy("group").applyInPandas(run, "group string, model string").write.mode("overwrite").parquet(f"{path}/model")
    elif algorithm == "GradientBoosting":
        model = T.boost_distributed(rows, {y: (cols, y)}, **{**T.BOOST, **settings})[y]
        spark.createDataFrame([(ALL, T.to_json(model))], "group string, model string").write.mode("overwrite").parquet(f"{path}/model")
    else:
        sigma, n = ML.label_std(rows, y)
        ML.feature_pipeline(cols, ML.make_estimator(algorithm, y, n, sigma)).fit(rows).write().overwrite().save(f"{path}/model")
    about = {**(manifest or {}), "mode": code, "algorithm": algorithm, "target": target, "features": cols, "n_train": rows.count()}
    spark.createDataFrame([(json.dumps(about),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _medians(rows: DataFrame, cols: list[str]) -> DataFrame:
    from airshed.operators.eda import exact_quantiles, long_form

    return exact_quantiles(long_form(rows.select(*cols), [], cols), "variable", "value", [0.5])


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def score(merged: DataFrame, path: str) -> DataFrame:
    """city_name, date, prediction (of the log target) of every row that the saved model serves."""
    spark = merged.sparkSession
    about = manifest(spark, path)
    mode, cols = ML.MODE_TABLE[about["mode"]], about["features"]
    rows, _ = mode_rows(merged, mode, split=False)
    if about["algorithm"] in G.LINEAR:
        models = spark.read.parquet(f"{path}/model").select("group", "medians", "intercept", "coefficients")
        rows = rows.join(models if mode.scope == "city" else F.broadcast(models), "group")
        rows = rows.select("city_name", "date", "intercept", "coefficients", *[F.coalesce(F.col(c), F.col("medians")[i]).alias(c) for i, c in enumerate(cols)])
        return G.predict(rows, cols).select("city_name", "date", "prediction")
    if mode.scope == "city":
        def run(key, frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if frame.empty or model.empty:
                return pd.DataFrame({"city_name": [], "date": [], "prediction": []})
            return frame[["city_name", "date"]].assign(prediction=T.from_json(model["model"].iloc[0]).predict(frame[cols].to_numpy(float)))

        models = spark.read.parquet(f"{path}/model").withColumnRenamed("group", "of")
        return rows.select("group", "city_name", "date", *cols).groupBy("group").cogroup(models.groupBy("of")).applyInPandas(run, "city_name string, date date, prediction double")
    if about["algorithm"] == "GradientBoosting":
        model = T.from_json(spark.read.parquet(f"{path}/model").first()["model"])
        return T.predict_with(rows.select("city_name", "date", *cols), model, cols).select("city_name", "date", "prediction")
    return PipelineModel.load(f"{path}/model").transform(rows).select("city_name", "date", "prediction")


def results_path(spark: SparkSession, key: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/results/{key}"


# ---------------------------------------------------------------- ladder and rolling origin


def ladder_report(rows: DataFrame, x: list[str], target: str, ladder: list[tuple[str, list[str]]]) -> DataFrame:
    """rung, feature_set, rmse, mae, r2 on the validation rows; every rung is solved from one Gram matrix of the train rows."""
    models = G.rungs(rows.where("split = 'train'"), x, f"{target}_log", ladder).collect()  # a few rungs
    each = [F.struct(F.lit(r["rung"]).alias("rung"), F.lit(r["label"]).alias("label"), F.lit(r["intercept"]).alias("intercept"),
                     F.array(*[F.lit(w) for w in r["coefficients"]]).alias("coefficients")) for r in models]
    pairs = rows.where("split = 'val'").withColumn("_m", F.explode(F.array(*each))).select("*", "_m.*").drop("_m")
    return ML.evaluate(G.predict(pairs, x), target, ["rung", "label"]).withColumnRenamed("label", "feature_set")


def rolling_validation(rows: DataFrame, x: list[str], target: str, days: int = 30) -> DataFrame:
    """fold, n_train, n_test, rmse, mae, r2: each period's rows predicted by the ridge of all rows before it.

    NULL features are the medians of the first period, which precedes every fold."""
    first = rows.agg(F.min("date")).first()[0]
    if first is None:
        return rows.sparkSession.createDataFrame([], "fold int, n_train long, n_test long, rmse double, mae double, r2 double")
    rows = rows.withColumn("period", F.floor(F.datediff("date", F.lit(first)) / days).cast("int"))
    rows = G.impute_by(rows, x, None, rows.where("period = 0")).cache()
    models = G.rolling(rows, "period", x, f"{target}_log")
    p = G.predict(rows.join(models, "period"), x)
    out = ML.evaluate(p, target, ["period", "n_train"]).join(p.groupBy("period").agg(F.count(F.lit(1)).alias("n_test")), "period")
    out = out.select(F.col("period").alias("fold"), "n_train", "n_test", "rmse", "mae", "r2").checkpoint()
    rows.unpersist()
    return out
