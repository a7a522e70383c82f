"""Feature table: preprocessing, calendar, lags, rolling, interactions, targets.

``build_features`` is one chain of ``DataFrame.transform`` steps; all window
steps share the per-city spec, so the whole table costs one shuffle by city
plus the scans.  Feature sets are projections chosen by configuration;
columns a set does not use are pruned by Catalyst before execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airshed.constants import (
    BASELINE_PM25,
    CALENDAR_COLS,
    ROLL_MEAN_WINDOWS,
    ROLL_STD_WINDOWS,
    TARGET_LAGS,
    WEATHER_COLS,
    WEATHER_LAG_COLS,
)
from airshed.functions.calendar import calendar_columns
from airshed.functions.units import snap
from airshed.operators import timeseries as ts
from airshed.operators.clean import clip_ranges

META = ["city_name", "date"]


def preprocess(df: DataFrame, target: str = "pm25") -> DataFrame:
    """Clip ranges, then per-city linear gap fill of the weather columns (edges held)."""
    return ts.interpolate_linear(clip_ranges(df, target), WEATHER_COLS)


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.select("*", *calendar_columns(F.col(date)))


def add_lags(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.select("*", *ts.lag_columns(targets))


def add_rolling(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.select("*", *ts.rolling_columns(targets))


def interaction_columns(target: str = "pm25", wind_target_source: str | None = None) -> list[Column]:
    """visibility_inverse, wind_{target}_product, temp_dewpoint_diff, has_precip (NULL precip -> 0).

    ``wind_target_source`` picks the column multiplied with wind (the same-day target for
    parity, or its lag-1 to avoid leakage when the horizon is 0)."""
    src = wind_target_source or target
    return [
        (F.lit(1.0) / (F.col("visibility_km") + F.lit(1.0))).alias("visibility_inverse"),
        (F.col("wind_speed_kmh") * F.col(src)).alias(f"wind_{target}_product"),
        (F.col("temp_avg_c") - F.col("dewpoint_c")).alias("temp_dewpoint_diff"),
        F.coalesce(F.col("precip_mm") > F.lit(0.0), F.lit(False)).cast("int").alias("has_precip"),
    ]


def weather_interaction_columns(key: str = "city_name") -> list[Column]:
    w = ts.spec(key)
    return [
        (F.col("wind_speed_kmh") * F.col("visibility_km")).alias("wind_x_visibility"),
        (F.col("temp_avg_c") - F.col("dewpoint_c")).alias("temp_minus_dewpoint"),
        (F.col("station_pressure_hpa") - F.lag("station_pressure_hpa", 1).over(w)).alias("pressure_change"),
    ]


def temperature_columns() -> list[Column]:
    t = F.col("temp_avg_c")
    ts_ = snap(t)
    m = F.month("date")
    cat = (F.when(t.isNull(), F.lit(None).cast("string")).when(ts_ <= 5, F.lit("cold")).when(ts_ <= 15, F.lit("cool"))
           .when(ts_ <= 25, F.lit("warm")).otherwise(F.lit("hot")))
    return [
        (t * t).alias("temp_squared"),
        cat.alias("temp_category"),
        m.isin(11, 12, 1, 2).cast("int").alias("is_winter"),
        m.isin(6, 7, 8).cast("int").alias("is_summer_ozone"),
    ]


def baseline_pm25(temp: Column, wind: Column, precip: Column) -> Column:
    """Heuristic next-day PM2.5 (defaults 20 C, 10 km/h, 0 mm when missing)."""
    a, b, tref, wref, wslope, pcap, pslope = BASELINE_PM25
    t = F.coalesce(temp, F.lit(20.0))
    wd = F.coalesce(wind, F.lit(10.0))
    p = F.coalesce(precip, F.lit(0.0))
    v = (F.lit(a) + F.lit(b) * (t - F.lit(tref)) + F.greatest(F.lit(0.0), F.lit(wslope) * (F.lit(wref) - wd))
         - F.lit(pslope) * F.least(p, F.lit(pcap)))
    return F.greatest(F.lit(0.0), v)


def weather_level_columns() -> list[Column]:
    vis = snap(F.col("visibility_km"))
    wind = snap(F.col("wind_speed_kmh"))
    vis_level = (F.when(vis.isNull(), F.lit(None).cast("int")).when(vis < 1, 0).when(vis < 4, 1).when(vis < 10, 2)
                 .when(vis < 50, 3).otherwise(4))
    # Beaufort-like bands in km/h
    wind_level = (F.when(wind.isNull(), F.lit(None).cast("int")).when(wind < 2, 0).when(wind < 6, 1)
                  .when(wind < 12, 2).when(wind < 20, 3).when(wind < 29, 4).when(wind < 39, 5).otherwise(6))
    p = snap(F.col("station_pressure_hpa"))
    return [
        vis_level.alias("visibility_level"),
        wind_level.alias("wind_level"),
        F.coalesce((wind < 5) & (p > 1010), F.lit(False)).cast("int").alias("is_stagnant"),
        F.coalesce((snap(F.col("dewpoint_c")) > 15) & (p < 1000), F.lit(False)).cast("int").alias("is_humid_low"),
        (F.coalesce(F.col("precip_mm"), F.lit(0.0)) * F.coalesce(F.col("wind_speed_kmh"), F.lit(0.0)))
        .alias("wet_deposition"),
    ]


def ratio_columns() -> list[Column]:
    return [
        F.try_divide(F.col("pm25"), F.col("pm10")).alias("pm25_pm10_ratio"),
        F.try_divide(F.col("no2"), F.col("so2")).alias("no2_so2_ratio"),
        F.try_divide(F.col("o3"), F.col("no2")).alias("o3_no2_ratio"),
    ]


FEATURE_SETS = ("weather", "temporal", "lag", "full")


def feature_columns(experiment: str, targets: list[str]) -> list[str]:
    cols = list(WEATHER_COLS) + list(CALENDAR_COLS)
    if experiment in ("lag", "full"):
        cols += [f"{t}_lag{k}" for t in targets for k in TARGET_LAGS] + [f"{c}_lag1" for c in WEATHER_LAG_COLS]
        cols += [f"{t}_roll{k}_mean" for t in targets for k in ROLL_MEAN_WINDOWS]
        cols += [f"{t}_roll{k}_std" for t in targets for k in ROLL_STD_WINDOWS]
    if experiment == "full":
        cols += ["visibility_inverse", f"wind_{targets[0]}_product", "temp_dewpoint_diff", "has_precip"]
    return cols


def build_features(merged: DataFrame, experiment: str = "full", targets: list[str] | None = None,
                   horizon: int = 1, log_target: bool = True, drop_null_target: bool = True) -> DataFrame:
    """Feature table for an experiment: metadata + targets first, NULL targets dropped (keep them
    with ``drop_null_target=False`` to score the latest days, whose future is not known yet).

    ``weather``/``temporal`` are same-day (horizon ignored); ``lag``/``full`` shift every target by
    ``horizon`` rows inside the city."""
    targets = targets or ["pm25"]
    main = targets[0]
    df = preprocess(merged, main)
    df = add_calendar(df)
    same_day = experiment in ("weather", "temporal")
    if not same_day:
        df = add_lags(df, targets)
        df = add_rolling(df, targets)
    if experiment == "full":
        df = df.select("*", *interaction_columns(main))
    if not same_day and horizon > 0:
        df = df.select(*[c for c in df.columns if c not in targets],
                       *[ts.future_target(t, horizon).alias(t) for t in targets])
    target_cols = []
    for t in targets:
        target_cols.append(t)
        if log_target:
            df = df.withColumn(f"{t}_log", F.log1p(F.col(t)))
            target_cols.append(f"{t}_log")
    out = df.select(*META, *target_cols, *feature_columns(experiment, targets))
    return out.na.drop(subset=targets, how="any") if drop_null_target else out


# ------------------------------------------------------------ preparation
def impute(df: DataFrame, cols: list[str], strategy: str = "median", fill_value: float = 0.0,
           stats_from: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the median / mean (of ``stats_from``, default ``df``) or a constant.

    Statistics are one fitted row; medians are exact and found without gathering a column in one task."""
    if strategy == "constant":
        return df.na.fill({c: float(fill_value) for c in cols})
    src = stats_from if stats_from is not None else df
    if strategy == "median":
        from airshed.operators.eda import exact_quantiles, long_form

        found = {r["variable"]: r["q"][0] for r in exact_quantiles(long_form(src.select(*cols), [], cols), "variable", "value", [0.5]).collect()}
        stats = {c: found.get(c) for c in cols}
    else:
        stats = src.agg(*[F.avg(F.col(c)).alias(c) for c in cols]).first().asDict()
    return df.select(*[F.coalesce(F.col(c), F.lit(stats[c]).cast("double")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def one_hot(df: DataFrame, col: str, categories: list[str], drop_first: bool = False) -> DataFrame:
    """One 0/1 column per category (``col_value``); unseen values -> all zeros."""
    cats = sorted(categories)[1:] if drop_first else sorted(categories)
    return df.select(*[c for c in df.columns if c != col],
                     *[(F.col(col) == F.lit(v)).cast("int").alias(f"{col}_{v}") for v in cats])
