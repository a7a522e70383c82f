"""Registered queries: modelling (pyspark.ml).  Rows-only except the routing rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airshed.operators import experiments as EX
from airshed.operators import features as FE
from airshed.operators import ml as ML
from airshed.operators import split as SP
from airshed.plans.finish import round4
from airshed.plans.oracle_views import with_views as V
from airshed.plans.pipeline import CityPipeline, stored_merged, table_key
from airshed.plans.q_series import _features_sql
from airshed.plans.registry import query
from airshed.session import checkpoint_dir


def merged(spark, d):
    """The stored merged city-day table (written once by the ETL, then scanned)."""
    return stored_merged(spark, d)


def _codes(scope):
    return [m.code for m in ML.MODE_TABLE.values() if m.scope == scope]


def _registry(spark, d):
    """Where the results of these inputs are kept."""
    p = CityPipeline(spark, d)
    return EX.results_path(spark, table_key(p))


def _recorded(spark, d, part, parts):
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return EX.record(out, _registry(spark, d), part)


@query("experiment_grid")
def experiment_grid(spark, d):
    """Ridge, lasso and elastic net in all eight modes, with a row for every city of the city
    modes; each mode's models come from one aggregate.  Like the other experiments it is stored in the
    result registry, from which ``production_fit`` chooses."""
    m = merged(spark, d)
    return _recorded(spark, d, "linear", [EX.linear(m, code) for code in ML.MODE_TABLE])


@query("experiment_forest")
def experiment_forest(spark, d):
    """Random forest (100 trees, depth 15) in the four global modes."""
    return _recorded(spark, d, "forest_global", [EX.global_forest(merged(spark, d), _codes("global"))])


@query("experiment_forest_city")
def experiment_forest_city(spark, d):
    """Random forests of every city in the four city modes; a mode's cities are one job."""
    m = merged(spark, d)
    return _recorded(spark, d, "forest_city", [EX.city_trees(m, code, ["RandomForest"]) for code in _codes("city")])


@query("experiment_boosting")
def experiment_boosting(spark, d):
    """Histogram gradient boosting (200 rounds, depth 5, 31 leaves, NULLs routed) in the four global modes."""
    return _recorded(spark, d, "boosting_global", [EX.global_boosting(merged(spark, d), _codes("global"))])


@query("experiment_boosting_city")
def experiment_boosting_city(spark, d):
    """Histogram gradient boosting of every city in the four city modes."""
    m = merged(spark, d)
    return _recorded(spark, d, "boosting_city", [EX.city_trees(m, code, ["GradientBoosting"]) for code in _codes("city")])


_MODES_SQL = "\nUNION ALL\n".join(
    f"SELECT '{r[0]}' AS mode, '{r[1]}' AS scope, '{r[2]}' AS history, '{r[3]}' AS targets, '{r[4]}' AS experiment, "
    f"{r[5]} AS horizon, '{r[6]}' AS target_list, count(CASE WHEN pm25 IS NOT NULL"
    + (" AND o3 IS NOT NULL" if r[3] == "multi" else "") + " THEN 1 END) AS n_rows FROM merged" for r in ML.mode_rows())


@query("modes", V("merged") + _MODES_SQL)
def modes(spark, d):
    """The eight modes as a table, with the number of city-day rows each can train on."""
    m = merged(spark, d)
    n_pm = m.where(F.col("pm25").isNotNull()).count()
    n_multi = m.where(F.col("pm25").isNotNull() & F.col("o3").isNotNull()).count()
    rows = [r + (n_multi if r[3] == "multi" else n_pm,) for r in ML.mode_rows()]
    return spark.createDataFrame(rows, "mode string, scope string, history string, targets string, "
                                       "experiment string, horizon int, target_list string, n_rows long")


@query("feature_importance")
def feature_importance(spark, d):
    """Random-forest importances (sorted), on the full feature set."""
    feats = FE.build_features(merged(spark, d), "full", ["pm25"], horizon=1)
    cols = FE.feature_columns("full", ["pm25"])
    feats = ML.as_double(feats, cols)
    est = ML.make_estimator("RandomForest", "pm25_log", 0, 0.0)
    model = ML.feature_pipeline(cols, est).fit(feats)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(cols, [float(x) for x in imp]), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")


@query("linear_coefficients")
def linear_coefficients(spark, d):
    """L5 for linear models: |coefficient| per feature (Ridge), sorted."""
    feats = FE.build_features(merged(spark, d), "weather", ["pm25"], horizon=0)
    cols = FE.feature_columns("weather", ["pm25"])
    feats = ML.as_double(feats, cols)
    sigma, n = ML.label_std(feats, "pm25_log")
    model = ML.feature_pipeline(cols, ML.make_estimator("Ridge", "pm25_log", n, sigma)).fit(feats)
    coef = model.stages[-1].coefficients.toArray().tolist()
    rows = sorted(zip(cols, [abs(float(x)) for x in coef]), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, abs_coefficient double")


@query("multi_output")
def multi_output(spark, d):
    """All targets on the same X from one aggregate and one factorisation (ridge, mode GHM)."""
    return EX.linear(merged(spark, d), "GHM", ("Ridge",)).select(
        F.explode(F.array(*[F.struct("target", F.lit(s).alias("split"), *[F.col(f"{s}_{k}").alias(k) for k in ("rmse", "mae", "r2")]) for s in ("val", "test")])).alias("r")).select("r.*")


@query("city_models")
def city_models(spark, d):
    """One ridge per eligible city (grouped normal equations on its train split, medians learnt
    there) with val and test metrics; all cities in a few aggregates."""
    return ML.city_experiment(merged(spark, d), ML.MODE_TABLE["CTS"], "pm25").drop("mode", "target")


@query("city_tree_models")
def city_tree_models(spark, d):
    """L7 for trees: forest and boosting of every eligible city on the weather features, all cities in one job."""
    return EX.city_trees(merged(spark, d), "CTS").drop("mode", "target")


@query("batch_scoring")
def batch_scoring(spark, d):
    """Features -> predict -> expm1 -> predicted_pm25 -> AQI / category of the prediction."""
    feats = FE.build_features(merged(spark, d), "weather", ["pm25"], horizon=0)
    cols = FE.feature_columns("weather", ["pm25"])
    feats = ML.as_double(feats, cols)
    train = SP.chrono_split(feats).where(F.col("split") == "train")
    sigma, n = ML.label_std(train, "pm25_log")
    model = ML.feature_pipeline(cols, ML.make_estimator("Ridge", "pm25_log", n, sigma)).fit(train)
    return ML.score_with_aqi(model, feats, ["city_name", "date", "pm25"])


@query("production_fit")
def production_fit(spark, d):
    """The best mode and algorithm by validation RMSE among all results that the registry holds for these
    inputs (the linear ones are made if none are there; any mode and algorithm that was run can win) is fitted
    on all data and saved with a manifest of the choice; the scores come from the artefact, read back."""
    import uuid
    from airshed.streaming.hourly import _drop
    m = merged(spark, d)
    path = _registry(spark, d)
    if "linear" not in dict(EX.versions(spark, path)):
        _recorded(spark, d, "linear", [EX.linear(m, code) for code in ML.MODE_TABLE])
    best = EX.choose(EX.registered(spark, path))
    base = f"{checkpoint_dir(spark).rstrip('/')}/models/{best['mode']}-{uuid.uuid4().hex}"
    EX.train(m, best["mode"], best["algorithm"], base, manifest={**best, "results": EX.versions(spark, path)})
    out = ML.with_aqi(EX.score(m, base), ["city_name", "date"]).checkpoint()
    _drop(spark, base)
    return out


@query("route_mode", V("merged") + """
SELECT city_name, count(pm25) AS history_rows,
  CASE WHEN count(pm25) >= 7 THEN 'GHS' WHEN count(*) > 0 THEN 'GTS' END AS route FROM merged GROUP BY city_name""")
def route_mode(spark, d):
    """>= 7 history rows -> GHS, else GTS."""
    m = merged(spark, d)
    return m.groupBy("city_name").agg(F.count("pm25").cast("long").alias("history_rows"), F.count("*").alias("_n")) \
        .select("city_name", "history_rows",
                F.when(F.col("history_rows") >= 7, "GHS").when(F.col("_n") > 0, "GTS").alias("route"))


FORECAST_DAYS = 7


@query("rolling_forecast")
def rolling_forecast(spark, d):
    """Seven-day rolling forecast per city with the fitted feature model (ridge on the full set,
    next-day target).  Each day's prediction joins the history, the lag and rolling features are
    computed anew from it, and the weather of days to come is each city's last known one."""
    m = merged(spark, d)
    cols = FE.feature_columns("full", ["pm25"])
    train = ML.as_double(FE.build_features(m, "full", ["pm25"], horizon=1), cols)
    sigma, n = ML.label_std(train, "pm25_log")
    model = ML.feature_pipeline(cols, ML.make_estimator("Ridge", "pm25_log", n, sigma)).fit(train)
    # the longest window reads 30 rows back; 40 of a city's rows are the working history
    newest = Window.partitionBy("city_name").orderBy(F.col("date").desc())
    history = m.select("*", F.row_number().over(newest).alias("_r")).where("_r <= 40").drop("_r")
    checkpoint_dir(spark)
    history = history.checkpoint()
    for _ in range(FORECAST_DAYS):
        feats = ML.as_double(FE.build_features(history, "full", ["pm25"], horizon=1, drop_null_target=False), cols)
        last = feats.select("*", F.row_number().over(newest).alias("_r")).where("_r = 1")
        made = model.transform(last).select("city_name", F.date_add("date", 1).alias("_next"),
                                            F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("_pm25"))
        row = history.select("*", F.row_number().over(newest).alias("_r")).where("_r = 1").drop("_r").join(made, "city_name")
        row = row.select(*[F.col("_next").alias(c) if c == "date" else F.year("_next").alias(c) if c == "year"
                           else F.col("_pm25").alias(c) if c == "pm25" else F.col(c) for c in history.columns])
        history = history.unionByName(row).checkpoint()  # cuts the lineage of this step
    newest_days = history.select("city_name", "date", F.col("pm25").alias("forecast"), (F.lit(FORECAST_DAYS + 1) - F.row_number().over(newest)).alias("step"))
    return newest_days.where("step >= 1").select("city_name", "step", "date", "forecast")


@query("ablation")
def ablation(spark, d):
    """Ablation ladder for the next day's PM2.5: weather, +time, +lag 1, +lags to 7 and rolling, +interactions,
    +static city features (position, log population, elevation of the city's stations), and as a control the fourth
    rung with the city's fingerprint (mean, spread and season variance over the train rows).  One Gram matrix of all
    candidates gives every rung; all have the same rows and split.  A rung improves if its RMSE is 2 % below the rung before
    (the control: below the fourth)."""
    from airshed.constants import CALENDAR_COLS, WEATHER_COLS, WEATHER_LAG_COLS
    from airshed.operators.merge import normalise_city_name
    from airshed.sources import domain
    mode = ML.MODE_TABLE["GHS"]
    c = domain.cities(spark, d)
    height = domain.stations(spark, d).groupBy("home_city_id").agg(F.avg("elev_m").alias("city_elev"))
    c = c.join(height, c["city_id"] == height["home_city_id"], "left")
    static = ["city_lat", "city_lng", "city_log_pop", "city_elev"]
    c = c.select(normalise_city_name(F.col("city_name")).alias("city_name"), F.col("lat").alias("city_lat"), F.col("lng").alias("city_lng"),
                 F.log(F.col("population").cast("double")).alias("city_log_pop"), "city_elev")
    rows, every = EX.mode_rows(merged(spark, d), mode)
    rows = rows.join(c, "city_name").cache()
    known = rows.where("split = 'train'")
    seasons = known.groupBy("city_name", F.floor((F.month("date") % 12) / 3).alias("s")).agg(F.avg("pm25").alias("sm")).groupBy("city_name").agg(F.var_samp("sm").alias("print_season"))
    prints = known.groupBy("city_name").agg(F.avg("pm25").alias("print_mean"), F.stddev_samp("pm25").alias("print_sd")).join(seasons, "city_name")
    fingerprint = ["print_mean", "print_sd", "print_season"]
    x = every + static + fingerprint
    rows = EX.filled(ML.as_double(rows.join(prints, "city_name", "left"), x), x, mode)
    lag1 = ["pm25_lag1", *[f"{w}_lag1" for w in WEATHER_LAG_COLS]]
    more = [f for f in every if "_lag" in f or "_roll" in f]
    steps = [("weather", list(WEATHER_COLS)), ("+time", list(CALENDAR_COLS)), ("+lag1", lag1), ("+lag7/rolling", [f for f in more if f not in lag1])]
    steps += [("+interactions", [f for f in every if f not in (*WEATHER_COLS, *CALENDAR_COLS, *more)]), ("+static", static)]
    ladder, cols = [], []
    for label, new in steps:
        cols = cols + [f for f in new if f in x and f not in cols]
        ladder.append((label, cols))
    ladder.append(("+lag7/rolling+fingerprint", ladder[3][1] + fingerprint))
    found = {r["rung"]: r for r in EX.ladder_report(rows, x, "pm25", ladder).collect()}  # a row for each rung
    out = []
    for k, (label, _) in enumerate(ladder):
        before = None if k == 0 else found[3 if k == len(ladder) - 1 else k - 1]["rmse"]
        r = found[k]
        out.append((k, label, r["rmse"], r["mae"], r["r2"], None if before is None else bool(r["rmse"] <= before * 0.98)))
    return spark.createDataFrame(out, "rung int, feature_set string, rmse double, mae double, r2 double, improves_2pct boolean")


@query("rolling_validation")
def rolling_validation(spark, d):
    """Rolling-origin validation: every 30-day window is predicted by the ridge of all days before it."""
    rows, cols = EX.mode_rows(merged(spark, d), ML.MODE_TABLE["GHS"], split=False)
    return EX.rolling_validation(rows, cols, "pm25")


@query("one_hot_train_fit", V("merged") + """
SELECT m.city_name, m.date, list_transform(c.names, lambda x: CAST(x = m.city_name AS DOUBLE)) AS city_onehot
FROM merged m, (SELECT list_sort(list(DISTINCT city_name)) AS names FROM merged WHERE date < DATE '1999-01-01') c""")
def one_hot_train_fit(spark, d):
    """One-hot fitted on the training period; unseen categories -> all-zero vector."""
    m = merged(spark, d).select("city_name", "date", "pm25")
    train = m.where(F.col("date") < F.lit("1999-01-01").cast("date"))
    enc = ML.one_hot_train_fit(train, m, "city_name")
    from pyspark.ml.functions import vector_to_array
    return enc.select("city_name", "date", vector_to_array("city_name_vec").alias("city_onehot"))


@query("split_xy", _features_sql("weather", ["pm25"], 0, "SELECT city_name, date, ["
       + ", ".join(f"floor(CAST({c} AS DOUBLE) * 10000e0 + 0.500123456e0) / 10000e0" for c in FE.feature_columns("weather", ["pm25"]))
       + "] AS X, pm25_log AS y FROM feats"), ["y"])
def split_xy(spark, d):
    """X (assembled feature vector to 4 decimals, null where a feature is missing) / y (log target)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    feats = FE.build_features(merged(spark, d), "weather", ["pm25"], horizon=0)
    cols = FE.feature_columns("weather", ["pm25"])
    feats = ML.as_double(feats, cols)
    va = VectorAssembler(inputCols=cols, outputCol="X", handleInvalid="keep")
    out = va.transform(feats).select("city_name", "date", vector_to_array("X").alias("X"), F.col("pm25_log").alias("y"))
    return out.withColumn("X", F.transform("X", lambda v: F.when(~F.isnan(v), round4(v))))


@query("feature_select", _features_sql("full", ["pm25"], 1, "SELECT feature, non_null FROM (SELECT "
       + ", ".join(f"count({c}) AS {c}" for c in FE.feature_columns("full", ["pm25"]))
       + " FROM feats) UNPIVOT (non_null FOR feature IN (" + ", ".join(FE.feature_columns("full", ["pm25"])) + ")) WHERE non_null > 0"))
def feature_select(spark, d):
    """Numeric feature selection by schema; all-NULL columns dropped (one count aggregate)."""
    feats = FE.build_features(merged(spark, d), "full", ["pm25"], horizon=1)
    numeric = [f.name for f in feats.schema.fields
               if f.dataType.typeName() in ("double", "integer", "long", "float")
               and f.name not in ("pm25", "pm25_log")]
    counts = feats.agg(*[F.count(c).alias(c) for c in numeric]).first().asDict()
    keep = [c for c in numeric if counts[c] > 0]
    return spark.createDataFrame([(c, int(counts[c])) for c in keep], "feature string, non_null long")


@query("forecast_next_day")
def forecast_next_day(spark, d):
    """E3 / L11 + J10: next-day PM2.5 per city from its latest history row (as-of scoring): a
    T+1 Ridge model on the full feature set is applied to each city's last day, whose target is
    not known yet; prediction -> expm1 -> AQI -> category -> advice.  One batch job for all cities."""
    from airshed.functions import aqi as A
    feats = FE.build_features(merged(spark, d), "full", ["pm25"], horizon=1, drop_null_target=False)
    cols = FE.feature_columns("full", ["pm25"])
    feats = ML.as_double(feats, cols)
    train = feats.where(F.col("pm25").isNotNull())
    sigma, n = ML.label_std(train, "pm25_log")
    model = ML.feature_pipeline(cols, ML.make_estimator("Ridge", "pm25_log", n, sigma)).fit(train)
    latest_w = Window.partitionBy("city_name").orderBy(F.col("date").desc())
    latest = feats.select("*", F.row_number().over(latest_w).alias("_r")).where("_r = 1").drop("_r")
    scored = ML.score_with_aqi(model, latest, ["city_name", "date"])
    return scored.select("city_name", F.col("date").alias("as_of"), F.date_add("date", 1).alias("forecast_date"),
                         "predicted_pm25", "predicted_aqi", "predicted_category",
                         A.advice_field(F.col("predicted_category"), 3).alias("recommendation"))
