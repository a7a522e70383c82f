"""Registered queries: windows, gap filling, features, splits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from airshed.constants import (
    HIGH_POLLUTION,
    ROLL_MEAN_WINDOWS,
    ROLL_STD_WINDOWS,
    TARGET_LAGS,
    WEATHER_COLS,
    WEATHER_LAG_COLS,
)
from airshed.functions.calendar import calendar_columns, period_flag_columns
from airshed.operators import coast
from airshed.operators import features as FE
from airshed.operators import split as SP
from airshed.operators import timeseries as ts
from airshed.operators.clean import clip_ranges
from airshed.plans.oracle_views import with_views as V
from airshed.plans.pipeline import CityPipeline, stored_merged
from airshed.plans.registry import query
from airshed.plans.sqlgen import aqi_sql, category_sql
from airshed.plans.sqlgen import snap_sql as S
from airshed.sources import domain

W = "PARTITION BY city_name ORDER BY date"
BACK = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FWD = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def merged(spark, d):
    """The stored merged city-day table (written once by the ETL, then scanned)."""
    return stored_merged(spark, d)


# ------------------------------------------------------------- SQL helpers
def _clip_sql(c, lo, hi):
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({lo}e0, least({c}, {hi}e0)) END"


CLIPPED = ("SELECT city_name, date, year, " + ", ".join(
    _clip_sql(c, *{"temp_avg_c": (-30, 45), "temp_max_c": (-25, 50), "temp_min_c": (-35, 40)}[c]) + f" AS {c}"
    if c in ("temp_avg_c", "temp_max_c", "temp_min_c") else c for c in WEATHER_COLS)
    + ", " + _clip_sql("pm25", 0, 500) + " AS pm25, pm10, o3, no2, so2, co FROM merged")


def _lin_sql(src: str, cols: list[str], keep: list[str]) -> str:
    inner = f"SELECT *, row_number() OVER ({W}) AS pos FROM {src}"
    parts = []
    for c in cols:
        pv = f"last_value({c} IGNORE NULLS) OVER {BACK}"
        pp = f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER {BACK}"
        nv = f"first_value({c} IGNORE NULLS) OVER {FWD}"
        np_ = f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER {FWD}"
        parts.append(f"coalesce({c}, ({pv}) + (({nv}) - ({pv})) * (pos - ({pp})) / (({np_}) - ({pp})), {pv}, {nv}) AS {c}")
    return f"SELECT {', '.join(keep)}, {', '.join(parts)} FROM ({inner}) i"


def _time_sql(src: str, cols: list[str], keep: list[str], limit: int = 3) -> str:
    inner = f"SELECT *, row_number() OVER ({W}) AS pos, CAST(date - DATE '1970-01-01' AS BIGINT) AS dday FROM {src}"
    parts = []
    for c in cols:
        pv = f"last_value({c} IGNORE NULLS) OVER {BACK}"
        pp = f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER {BACK}"
        pd_ = f"last_value(CASE WHEN {c} IS NOT NULL THEN dday END IGNORE NULLS) OVER {BACK}"
        nv = f"first_value({c} IGNORE NULLS) OVER {FWD}"
        nd = f"first_value(CASE WHEN {c} IS NOT NULL THEN dday END IGNORE NULLS) OVER {FWD}"
        inside = f"({pv}) + (({nv}) - ({pv})) * (dday - ({pd_})) / (({nd}) - ({pd_}))"
        fill = f"CASE WHEN {c} IS NULL AND ({pv}) IS NOT NULL AND pos - ({pp}) <= {limit} THEN coalesce({inside}, {pv}) END"
        parts.append(f"coalesce({c}, {fill}) AS {c}")
        parts.append(f"({c} IS NULL AND ({fill}) IS NOT NULL) AS {c}_interpolated")
    return f"SELECT {', '.join(keep)}, {', '.join(parts)} FROM ({inner}) i"


PRE = _lin_sql("clipped", WEATHER_COLS, ["city_name", "date", "year", "pm25", "pm10", "o3", "no2", "so2", "co"])


def _cal_sql(d="date"):
    return (f"CAST(dayofyear({d}) AS INTEGER) AS day_of_year, "
            f"sin({2 * math.pi!r}e0 * dayofyear({d}) / 365e0) AS day_sin, "
            f"cos({2 * math.pi!r}e0 * dayofyear({d}) / 365e0) AS day_cos, "
            f"CAST(month({d}) AS INTEGER) AS month, "
            f"sin({2 * math.pi!r}e0 * month({d}) / 12e0) AS month_sin, "
            f"cos({2 * math.pi!r}e0 * month({d}) / 12e0) AS month_cos, "
            f"CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week, "
            f"CAST(isodow({d}) - 1 IN (5, 6) AS INTEGER) AS is_weekend, "
            f"CAST(floor((month({d}) % 12) / 3) AS INTEGER) AS season, "
            f"CAST(quarter({d}) AS INTEGER) AS quarter")


def _lags_sql(targets):
    parts = [f"lag({t}, {k}) OVER ({W}) AS {t}_lag{k}" for t in targets for k in TARGET_LAGS]
    parts += [f"lag({c}, 1) OVER ({W}) AS {c}_lag1" for c in WEATHER_LAG_COLS]
    return ", ".join(parts)


def _roll_sql(targets):
    parts = []
    for t in targets:
        parts += [f"avg({t}) OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {t}_roll{k}_mean"
                  for k in ROLL_MEAN_WINDOWS]
        parts += [f"stddev_samp({t}) OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {t}_roll{k}_std"
                  for k in ROLL_STD_WINDOWS]
    return ", ".join(parts)


def _roll_names(targets):
    return [f"{t}_roll{k}_mean" for t in targets for k in ROLL_MEAN_WINDOWS] + \
        [f"{t}_roll{k}_std" for t in targets for k in ROLL_STD_WINDOWS]


# ------------------------------------------------------------------ windows
_LAGN = [f"{t}_lag{k}" for t in ("pm25", "o3") for k in TARGET_LAGS] + [f"{c}_lag1" for c in WEATHER_LAG_COLS]


@query("lag_features", V("merged") + f"SELECT city_name, date, pm25, o3, {_lags_sql(['pm25', 'o3'])} FROM merged",
       ["pm25", "o3"] + _LAGN)
def lag_features(spark, d):
    """Target lags 1,2,3,7 (pm25, o3) and weather lag-1 per city (row based)."""
    m = merged(spark, d)
    return m.select("city_name", "date", "pm25", "o3", *ts.lag_columns(["pm25", "o3"]))


@query("rolling_features", V("merged") + f"SELECT city_name, date, pm25, {_roll_sql(['pm25'])} FROM merged",
       ["pm25"] + _roll_names(["pm25"]))
def rolling_features(spark, d):
    """Past-only rolling mean 7/14/30 and sample std 7/14 (shift 1, min_periods 1), grouped per city."""
    m = merged(spark, d)
    return m.select("city_name", "date", "pm25", *ts.rolling_columns(["pm25"]))


_CAL = "PARTITION BY city_name ORDER BY date RANGE BETWEEN INTERVAL {a} DAY PRECEDING AND INTERVAL {b} DAY PRECEDING"
_CAL_NAMES = [f"pm25_lag{k}d" for k in TARGET_LAGS] + [f"pm25_roll{k}d_mean" for k in ROLL_MEAN_WINDOWS]


@query("calendar_windows", V("merged") + "SELECT city_name, date, pm25, " + ", ".join(
    [f"max(pm25) OVER ({_CAL.format(a=k, b=k)}) AS pm25_lag{k}d" for k in TARGET_LAGS]
    + [f"avg(pm25) OVER ({_CAL.format(a=k, b=1)}) AS pm25_roll{k}d_mean" for k in ROLL_MEAN_WINDOWS]) + " FROM merged",
       ["pm25"] + _CAL_NAMES)
def calendar_windows(spark, d):
    """W1/W3 by the calendar: the value k days ago (NULL if that day is absent) and past-only means
    over k days, whatever rows those days have."""
    return merged(spark, d).select("city_name", "date", "pm25", *ts.calendar_columns("pm25"))


@query("future_target", V("merged") + f"SELECT city_name, date, pm25, lead(pm25, 1) OVER ({W}) AS pm25_future_1d "
       "FROM merged", ["pm25", "pm25_future_1d"])
def future_target(spark, d):
    """T+1 target per city."""
    m = merged(spark, d)
    return m.select("city_name", "date", "pm25", ts.future_target("pm25", 1))


@query("interpolate_linear", V("merged", extra=[("clipped", CLIPPED)]) +
       _lin_sql("clipped", WEATHER_COLS, ["city_name", "date"]), WEATHER_COLS)
def interpolate_linear(spark, d):
    """Clip, then linear gap fill by row position per city, edges held."""
    m = clip_ranges(merged(spark, d)).select("city_name", "date", *WEATHER_COLS)
    return ts.interpolate_linear(m, WEATHER_COLS)


_WC = "SELECT replace(c.city_name, '_', ' ') AS city_name, w.* EXCLUDE (city_id) FROM weather_city w JOIN city c ON w.city_id = c.city_id"


@query("interpolate_time_limit", V("weather_city", "city", extra=[("wc", _WC)]) +
       _time_sql("wc", WEATHER_COLS, ["city_name", "date"]),
       WEATHER_COLS)
def interpolate_time_limit(spark, d):
    """Time-weighted gap fill, at most 3 consecutive rows per gap, tail extended, head untouched."""
    from airshed.operators.merge import normalise_city_name
    from airshed.sources import domain
    p = CityPipeline(spark, d)
    names = domain.cities(spark, d).select("city_id", normalise_city_name(F.col("city_name")).alias("city_name"))
    wc = p.weather_city_days().join(names, "city_id").select("city_name", "date", *WEATHER_COLS)
    return ts.interpolate_time_limit(wc, WEATHER_COLS)


@query("pressure_change", V("merged") + "SELECT city_name, date, wind_speed_kmh * visibility_km AS wind_x_visibility, "
       "temp_avg_c - dewpoint_c AS temp_minus_dewpoint, "
       f"station_pressure_hpa - lag(station_pressure_hpa, 1) OVER ({W}) AS pressure_change FROM merged",
       ["wind_x_visibility", "temp_minus_dewpoint", "pressure_change"])
def pressure_change(spark, d):
    """Day-over-day pressure change and weather interactions."""
    return merged(spark, d).select("city_name", "date", *FE.weather_interaction_columns())


@query("history_features", V("merged") + f"""
SELECT city_name,
       max(CASE WHEN r = 1 THEN pm25 END) AS pm25_lag1,
       max(CASE WHEN r = 7 THEN pm25 END) AS pm25_lag7,
       avg(CASE WHEN r <= 7 THEN pm25 END) AS pm25_mean7,
       CASE WHEN count(*) >= 30 THEN avg(CASE WHEN r <= 30 THEN pm25 END) END AS pm25_mean30,
       max(date) AS last_date
FROM (SELECT *, row_number() OVER (PARTITION BY city_name ORDER BY date DESC) AS r FROM merged) x
GROUP BY city_name""", ["pm25_lag1", "pm25_lag7", "pm25_mean7", "pm25_mean30"])
def history_features(spark, d):
    """Latest history per city (as-of the last observed day): lag1, lag7, mean of last 7,
    mean of last 30 (NULL with fewer than 30 rows).  Rank filter + conditional aggregates."""
    m = merged(spark, d)
    w = Window.partitionBy("city_name").orderBy(F.col("date").desc())
    r = m.select("city_name", "date", "pm25", F.row_number().over(w).alias("r"))
    return r.groupBy("city_name").agg(
        F.max(F.when(F.col("r") == 1, F.col("pm25"))).alias("pm25_lag1"),
        F.max(F.when(F.col("r") == 7, F.col("pm25"))).alias("pm25_lag7"),
        F.avg(F.when(F.col("r") <= 7, F.col("pm25"))).alias("pm25_mean7"),
        F.when(F.count("*") >= 30, F.avg(F.when(F.col("r") <= 30, F.col("pm25")))).alias("pm25_mean30"),
        F.max("date").alias("last_date"))


@query("rolling_extremes", V("merged") + f"""
SELECT city_name, date, pm25,
       min(pm25) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pm25_roll7_min,
       max(pm25) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pm25_roll7_max FROM merged""",
       ["pm25", "pm25_roll7_min", "pm25_roll7_max"])
def rolling_extremes(spark, d):
    """Past-only rolling min/max over 7 rows."""
    w = ts.spec().rowsBetween(-7, -1)
    return merged(spark, d).select("city_name", "date", "pm25", F.min("pm25").over(w).alias("pm25_roll7_min"),
                                   F.max("pm25").over(w).alias("pm25_roll7_max"))


@query("pollution_streak", V("merged") + f"""
SELECT city_name, date, pm25, direction,
       CAST(CASE WHEN high THEN sum(CAST(high AS INTEGER)) OVER (PARTITION BY city_name, island ORDER BY date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS high_streak,
       CAST(CASE WHEN rising THEN sum(CAST(rising AS INTEGER)) OVER (PARTITION BY city_name, rise_island ORDER BY date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS rise_streak
FROM (
  SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER {BACK} AS island,
         sum(CASE WHEN rising THEN 0 ELSE 1 END) OVER {BACK} AS rise_island
  FROM (SELECT city_name, date, pm25, coalesce({S('pm25')} > {HIGH_POLLUTION}e0, false) AS high,
               coalesce(pm25 > lag(pm25, 1) OVER ({W}), false) AS rising,
               CASE WHEN lag(pm25, 1) OVER ({W}) IS NULL OR pm25 IS NULL THEN NULL
                    ELSE CAST(sign(pm25 - lag(pm25, 1) OVER ({W})) AS INTEGER) END AS direction
        FROM merged) a) b""", ["pm25"])
def pollution_streak(spark, d):
    """Consecutive high-pollution (>35) days, day-over-day direction, rising streak."""
    m = merged(spark, d).select("city_name", "date", "pm25")
    return ts.streak_lengths(m, "pm25", HIGH_POLLUTION)


@query("days_since_event", V("merged") + f"""
SELECT city_name, date,
       CAST(date_diff('day', last_value(CASE WHEN pm25 > {HIGH_POLLUTION}e0 THEN date END IGNORE NULLS)
                 OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date) AS INTEGER) AS days_since_high,
       CAST(date_diff('day', last_value(CASE WHEN precip_mm > 0e0 THEN date END IGNORE NULLS)
                 OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date) AS INTEGER) AS days_since_rain
FROM merged""")
def days_since_event(spark, d):
    """Days since the last earlier high-pollution day / rainy day."""
    m = merged(spark, d)
    return m.select("city_name", "date",
                    ts.days_since(F.col("pm25") > F.lit(HIGH_POLLUTION)).alias("days_since_high"),
                    ts.days_since(F.col("precip_mm") > F.lit(0.0)).alias("days_since_rain"))


@query("cross_lags", V("merged") + f"SELECT city_name, date, lag(o3, 1) OVER ({W}) AS o3_lag1_for_pm25, "
       f"lag(pm25, 1) OVER ({W}) AS pm25_lag1_for_o3, lag(no2, 1) OVER ({W}) AS no2_lag1_for_o3, "
       f"lag(o3, 1) OVER ({W}) AS o3_lag1_for_no2 FROM merged",
       ["o3_lag1_for_pm25", "pm25_lag1_for_o3", "no2_lag1_for_o3", "o3_lag1_for_no2"])
def cross_lags(spark, d):
    """Cross-pollutant lag features."""
    w = ts.spec()
    return merged(spark, d).select("city_name", "date", F.lag("o3", 1).over(w).alias("o3_lag1_for_pm25"),
                                   F.lag("pm25", 1).over(w).alias("pm25_lag1_for_o3"),
                                   F.lag("no2", 1).over(w).alias("no2_lag1_for_o3"),
                                   F.lag("o3", 1).over(w).alias("o3_lag1_for_no2"))


@query("rolling_folds", V("merged") + """
SELECT city_name, date, CAST(floor(date_diff('day', d0, date) / 30) AS INTEGER) AS fold
FROM merged, (SELECT min(date) AS d0 FROM merged) m""")
def rolling_folds(spark, d):
    """Rolling-origin fold id from date arithmetic (30-day windows)."""
    m = merged(spark, d)
    d0 = m.agg(F.min("date").alias("d0")).first()["d0"]  # one fitted scalar
    return m.select("city_name", "date", F.floor(F.datediff("date", F.lit(d0)) / 30).cast("int").alias("fold"))


# ------------------------------------------------------------- row features
_CAL_NUM = ["day_sin", "day_cos", "month_sin", "month_cos"]


@query("calendar_features", V("merged") + f"SELECT city_name, date, {_cal_sql()} FROM merged", _CAL_NUM)
def calendar_features(spark, d):
    """F8: day_of_year, cyclic day/month, weekday (0 = Monday), weekend, season, quarter."""
    return merged(spark, d).select("city_name", "date", *calendar_columns(F.col("date")))


@query("period_flags", V("merged") + """
SELECT city_name, date,
  CAST(month(date) IN (11, 12, 1, 2, 3) AS INTEGER) AS is_heating,
  CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_ozone_season,
  CAST(month(date) IN (3, 4) AS INTEGER) AS is_dust_season,
  CAST(isodow(date) = 1 AS INTEGER) AS is_monday,
  CAST(isodow(date) = 5 AS INTEGER) AS is_friday,
  CAST(month(date) IN (11, 12, 1, 2) AS INTEGER) AS is_winter,
  CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer_ozone,
  city_name || '_s' || CAST(CAST(floor((month(date) % 12) / 3) AS INTEGER) AS VARCHAR) AS city_season FROM merged""")
def period_flags(spark, d):
    """heating / ozone / dust seasons, Monday / Friday flags, city x season interaction key."""
    season = F.floor((F.month("date") % 12) / 3).cast("int").cast("string")
    return merged(spark, d).select("city_name", "date", *period_flag_columns(F.col("date")),
                                   F.concat(F.col("city_name"), F.lit("_s"), season).alias("city_season"))


def _coast_views() -> list[tuple[str, str]]:
    """Every city against every whole segment: great-circle distance to the arc, by vectors."""
    def vec(lat, lon):
        return [f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"]

    def dot(a, b):
        return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in "xyz") + ")"

    def cross(a, b, out):
        return ", ".join(f"{a}{j} * {b}{k} - {a}{k} * {b}{j} AS {out}{i}" for i, j, k in ("xyz", "yzx", "zxy"))

    named = ", ".join(f"{e} AS {n}{i}" for n, at in (("p", ("lat", "lng")), ("s", ("lat1", "lon1")), ("t", ("lat2", "lon2")))
                      for i, e in zip("xyz", vec(*at)))
    km = " * 6371e0"
    ends = [f"2e0 * asin(sqrt(pow(px - {e}x, 2) + pow(py - {e}y, 2) + pow(pz - {e}z, 2)) / 2e0){km}" for e in "st"]
    return [
        ("arc0", f"SELECT city_id, {named} FROM city CROSS JOIN coast_segment"),
        ("arc1", f"SELECT *, {cross('s', 't', 'n')} FROM arc0"),
        ("arc2", f"SELECT *, {cross('n', 's', 'u')}, {cross('n', 't', 'v')} FROM arc1"),
        ("coast", f"""SELECT city_id, CASE WHEN {S('min(km)')} < 100 THEN min(km) END AS coast_km FROM (
          SELECT city_id, CASE WHEN {dot('p', 'u')} >= 0 AND {dot('p', 'v')} <= 0 AND {dot('n', 'n')} > 0
            THEN asin(abs({dot('p', 'n')}) / sqrt({dot('n', 'n')})){km} ELSE least({ends[0]}, {ends[1]}) END AS km FROM arc2) t
          GROUP BY city_id"""),
    ]


@query("coast_flags", V("city", "coast_segment", extra=_coast_views()) + f"""
SELECT c.city_id, city_name, coast_km, CAST(coalesce({S('coast_km')} <= 50, false) AS INTEGER) AS is_coastal,
  CAST(coast_km IS NULL AS INTEGER) AS is_inland FROM city c LEFT JOIN coast ON c.city_id = coast.city_id""", ["coast_km"])
def coast_flags(spark, d):
    """distance to the nearest coast segment; coastal within 50 km, inland from 100 km on (grid-bucketed arcs)."""
    cities = CityPipeline(spark, d).cities()
    flags = coast.coast_flags(cities, domain.coast_segments(spark, d), "city_id")
    return flags.select("city_id", "city_name", "coast_km", "is_coastal", "is_inland")


@query("geo_interactions", V("weather_city", "city", "coast_segment", extra=_coast_views()) + """
SELECT w.city_id, w.date, coast_km, coast_km * wind_speed_kmh AS coast_wind,
  elev_m * station_pressure_hpa AS elevation_pressure, w.lat * temp_avg_c AS latitude_temperature
FROM weather_city w LEFT JOIN coast ON w.city_id = coast.city_id""",
       ["coast_km", "coast_wind", "elevation_pressure", "latitude_temperature"])
def geo_interactions(spark, d):
    """coast distance x wind, elevation x pressure, latitude x temperature of every city-day."""
    p = CityPipeline(spark, d)
    near = coast.coast_distance(p.cities(), domain.coast_segments(spark, d), "city_id")
    days = coast.geo_interactions(p.weather_city_days().join(near, "city_id", "left"))
    return days.select("city_id", "date", "coast_km", "coast_wind", "elevation_pressure", "latitude_temperature")


@query("log_target", V("merged") + "SELECT city_name, date, pm25, ln(1e0 + pm25) AS pm25_log, "
       "exp(ln(1e0 + pm25)) - 1e0 AS pm25_back FROM merged WHERE pm25 IS NOT NULL", ["pm25", "pm25_log", "pm25_back"])
def log_target(spark, d):
    """log1p target transform and its expm1 inverse."""
    m = merged(spark, d).where(F.col("pm25").isNotNull())
    return m.select("city_name", "date", "pm25", F.log1p("pm25").alias("pm25_log"),
                    F.expm1(F.log1p("pm25")).alias("pm25_back"))


@query("interaction_features", V("merged") + """
SELECT city_name, date, 1e0 / (visibility_km + 1e0) AS visibility_inverse, wind_speed_kmh * pm25 AS wind_pm25_product,
       temp_avg_c - dewpoint_c AS temp_dewpoint_diff, CAST(coalesce(precip_mm > 0e0, false) AS INTEGER) AS has_precip
FROM merged""", ["visibility_inverse", "wind_pm25_product", "temp_dewpoint_diff"])
def interaction_features(spark, d):
    """visibility inverse, wind x target, temperature-dewpoint spread, precipitation flag."""
    return merged(spark, d).select("city_name", "date", *FE.interaction_columns("pm25"))


@query("temperature_features", V("merged") + f"""
SELECT city_name, date, temp_avg_c * temp_avg_c AS temp_squared,
  CASE WHEN temp_avg_c IS NULL THEN NULL WHEN {S('temp_avg_c')} <= 5 THEN 'cold' WHEN {S('temp_avg_c')} <= 15 THEN 'cool'
       WHEN {S('temp_avg_c')} <= 25 THEN 'warm' ELSE 'hot' END AS temp_category,
  CAST(month(date) IN (11, 12, 1, 2) AS INTEGER) AS is_winter,
  CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer_ozone FROM merged""", ["temp_squared"])
def temperature_features(spark, d):
    """squared temperature, right-closed temperature bins, winter / summer-ozone flags."""
    return merged(spark, d).select("city_name", "date", *FE.temperature_columns())


_BASELINE_SQL = ("greatest(0e0, 30e0 + 0.3e0 * (coalesce(temp_avg_c, 20e0) - 20e0) + greatest(0e0, 0.5e0 * "
                 "(15e0 - coalesce(wind_speed_kmh, 10e0))) - 0.8e0 * least(coalesce(precip_mm, 0e0), 10e0))")


@query("baseline_pm25", V("merged", extra=[("b", f"SELECT city_name, date, {_BASELINE_SQL} AS baseline_pm25 FROM merged")])
       + f"SELECT city_name, date, baseline_pm25, {aqi_sql('baseline_pm25', 'pm25')} AS baseline_aqi, "
         f"{category_sql(aqi_sql('baseline_pm25', 'pm25'))} AS baseline_category FROM b", ["baseline_pm25"])
def baseline_pm25(spark, d):
    """heuristic PM2.5 from temperature, wind and precipitation, with the AQI and category
    of the predicted value."""
    from airshed.functions import aqi as A
    m = merged(spark, d)
    b = m.select("city_name", "date", FE.baseline_pm25(F.col("temp_avg_c"), F.col("wind_speed_kmh"),
                                                      F.col("precip_mm")).alias("baseline_pm25"))
    a = A.aqi_strict(F.col("baseline_pm25"), "pm25")
    return b.select("*", a.alias("baseline_aqi"), A.category(a).alias("baseline_category"))


@query("weather_levels", V("merged") + f"""
SELECT city_name, date,
  CASE WHEN visibility_km IS NULL THEN NULL WHEN {S('visibility_km')} < 1 THEN 0 WHEN {S('visibility_km')} < 4 THEN 1
       WHEN {S('visibility_km')} < 10 THEN 2 WHEN {S('visibility_km')} < 50 THEN 3 ELSE 4 END AS visibility_level,
  CASE WHEN wind_speed_kmh IS NULL THEN NULL WHEN {S('wind_speed_kmh')} < 2 THEN 0 WHEN {S('wind_speed_kmh')} < 6 THEN 1
       WHEN {S('wind_speed_kmh')} < 12 THEN 2 WHEN {S('wind_speed_kmh')} < 20 THEN 3 WHEN {S('wind_speed_kmh')} < 29 THEN 4
       WHEN {S('wind_speed_kmh')} < 39 THEN 5 ELSE 6 END AS wind_level,
  CAST(coalesce({S('wind_speed_kmh')} < 5 AND {S('station_pressure_hpa')} > 1010, false) AS INTEGER) AS is_stagnant,
  CAST(coalesce({S('dewpoint_c')} > 15 AND {S('station_pressure_hpa')} < 1000, false) AS INTEGER) AS is_humid_low,
  coalesce(precip_mm, 0e0) * coalesce(wind_speed_kmh, 0e0) AS wet_deposition FROM merged""", ["wet_deposition"])
def weather_levels(spark, d):
    """F16: visibility / wind levels, stagnation and humid-low flags, wet deposition proxy."""
    return merged(spark, d).select("city_name", "date", *FE.weather_level_columns())


@query("pollutant_ratios", V("merged") + """
SELECT city_name, date, CASE WHEN pm10 = 0 THEN NULL ELSE pm25 / pm10 END AS pm25_pm10_ratio,
  CASE WHEN so2 = 0 THEN NULL ELSE no2 / so2 END AS no2_so2_ratio,
  CASE WHEN no2 = 0 THEN NULL ELSE o3 / no2 END AS o3_no2_ratio FROM merged""",
       ["pm25_pm10_ratio", "no2_so2_ratio", "o3_no2_ratio"])
def pollutant_ratios(spark, d):
    """PM2.5/PM10, NO2/SO2, O3/NO2 (division by zero -> NULL)."""
    return merged(spark, d).select("city_name", "date", *FE.ratio_columns())


@query("clip_ranges", V("merged", extra=[("clipped", CLIPPED)]) +
       "SELECT city_name, date, temp_avg_c, temp_max_c, temp_min_c, pm25 FROM clipped",
       ["temp_avg_c", "temp_max_c", "temp_min_c", "pm25"])
def clip_ranges_q(spark, d):
    """Clip temperatures and the target, NULL preserved."""
    return clip_ranges(merged(spark, d)).select("city_name", "date", "temp_avg_c", "temp_max_c", "temp_min_c", "pm25")


# --------------------------------------------------------------- feature sets
def _features_sql(experiment: str, targets: list[str], horizon: int, outer: str = "") -> str:
    """SQL of a feature table; ``outer`` is a query over it, which it calls feats."""
    same_day = experiment in ("weather", "temporal")
    sel = ["*", _cal_sql()]
    if not same_day:
        sel += [_lags_sql(targets), _roll_sql(targets)]
    if experiment == "full":
        t = targets[0]
        sel += ["1e0 / (visibility_km + 1e0) AS visibility_inverse", f"wind_speed_kmh * {t} AS wind_{t}_product",
                "temp_avg_c - dewpoint_c AS temp_dewpoint_diff",
                "CAST(coalesce(precip_mm > 0e0, false) AS INTEGER) AS has_precip"]
    step = f"SELECT {', '.join(sel)} FROM pre"
    fut = ""
    if not same_day and horizon > 0:
        fut = ", ".join(f"lead({t}, {horizon}) OVER ({W}) AS {t}_f" for t in targets)
        step = f"SELECT *, {fut} FROM ({step}) s"
    tcols = []
    for t in targets:
        src = f"{t}_f" if fut else t
        tcols += [f"{src} AS {t}", f"ln(1e0 + {src}) AS {t}_log"]
    feats = FE.feature_columns(experiment, targets)
    notnull = " AND ".join(f"{(t + '_f') if fut else t} IS NOT NULL" for t in targets)
    body = f"SELECT city_name, date, {', '.join(tcols)}, {', '.join(feats)} FROM ({step}) z WHERE {notnull}"
    views = [("clipped", CLIPPED), ("pre", PRE)] + ([("feats", body)] if outer else [])
    return V("merged", extra=views) + (outer or body)


def _feature_doubles(experiment, targets):
    feats = FE.feature_columns(experiment, targets)
    ints = {"day_of_week", "is_weekend", "season", "has_precip"}
    return [c for c in feats if c not in ints] + [x for t in targets for x in (t, f"{t}_log")]


@query("features_weather", _features_sql("weather", ["pm25"], 0), _feature_doubles("weather", ["pm25"]))
def features_weather(spark, d):
    """F22 'weather'/'temporal' set: 8 weather + 7 calendar features, same-day target."""
    return FE.build_features(merged(spark, d), "weather", ["pm25"], horizon=0)


@query("features_lag", _features_sql("lag", ["pm25", "o3"], 1), _feature_doubles("lag", ["pm25", "o3"]))
def features_lag(spark, d):
    """F22 'lag' set for the multi-target modes: + lags and rolling stats, targets at T+1."""
    return FE.build_features(merged(spark, d), "lag", ["pm25", "o3"], horizon=1)


@query("features_full", _features_sql("full", ["pm25"], 1), _feature_doubles("full", ["pm25"]))
def features_full(spark, d):
    """F22 'full' set: + interactions, pm25 at T+1."""
    return FE.build_features(merged(spark, d), "full", ["pm25"], horizon=1)


@query("drop_null_target", V("merged") + "SELECT city_name, date, pm25, o3 FROM merged "
       "WHERE pm25 IS NOT NULL AND o3 IS NOT NULL", ["pm25", "o3"])
def drop_null_target(spark, d):
    """Rows with every target present (multi-output)."""
    return merged(spark, d).select("city_name", "date", "pm25", "o3").na.drop(subset=["pm25", "o3"], how="any")


_IMP = ["temp_avg_c", "visibility_km", "pm10"]


@query("impute_median", V("merged") + "SELECT city_name, date, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM merged)) AS {c}" for c in _IMP) + " FROM merged", _IMP)
def impute_median(spark, d):
    """NULL -> column median (exact)."""
    return FE.impute(merged(spark, d).select("city_name", "date", *_IMP), _IMP, "median")


@query("impute_mean", V("merged") + "SELECT city_name, date, " + ", ".join(
    f"coalesce({c}, (SELECT avg({c}) FROM merged)) AS {c}" for c in _IMP) + " FROM merged", _IMP)
def impute_mean(spark, d):
    """NULL -> column mean."""
    return FE.impute(merged(spark, d).select("city_name", "date", *_IMP), _IMP, "mean")


@query("impute_const", V("merged") + "SELECT city_name, date, " + ", ".join(
    f"coalesce({c}, 0e0) AS {c}" for c in _IMP) + " FROM merged", _IMP)
def impute_const(spark, d):
    """NULL -> constant 0."""
    return FE.impute(merged(spark, d).select("city_name", "date", *_IMP), _IMP, "constant", 0.0)


_TRAIN_CUT = "1999-04-01"


@query("impute_train_fit", V("merged") + "SELECT city_name, date, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM merged WHERE date < DATE '{_TRAIN_CUT}')) AS {c}"
    for c in _IMP) + f" FROM merged WHERE date >= DATE '{_TRAIN_CUT}'", _IMP)
def impute_train_fit(spark, d):
    """Medians fitted on the training period, applied to later rows."""
    m = merged(spark, d).select("city_name", "date", *_IMP)
    train = m.where(F.col("date") < F.lit(_TRAIN_CUT).cast("date"))
    test = m.where(F.col("date") >= F.lit(_TRAIN_CUT).cast("date"))
    return FE.impute(test, _IMP, "median", stats_from=train)


@query("one_hot", V("merged") + "SELECT date, pm25, " + ", ".join(
    f"CAST(CAST(isodow(date) - 1 AS VARCHAR) = '{v}' AS INTEGER) AS dow_{v}" for v in range(1, 7)) +
       " FROM merged", ["pm25"])
def one_hot(spark, d):
    """One-hot of a categorical column with drop-first (categories from the data, sorted)."""
    m = merged(spark, d).select("date", "pm25", F.weekday("date").cast("string").alias("dow"))
    cats = [r[0] for r in m.select("dow").distinct().collect()]  # bounded: the category list
    return FE.one_hot(m, "dow", cats, drop_first=True)


# ------------------------------------------------------------------- splits
_C_TEST, _C_VAL = SP.split_bounds()
_POS = """
SELECT m.*, p.before + row_number() OVER (PARTITION BY m.date ORDER BY m.city_name) - 1 AS pos, p.n FROM merged m
JOIN (SELECT date, coalesce(sum(cnt) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(cnt) OVER () AS n FROM (SELECT date, count(*) AS cnt FROM merged GROUP BY date) c) p ON m.date = p.date"""


@query("chrono_split", V("merged", extra=[("pos", _POS)]) + f"""
SELECT city_name, date, CASE WHEN pos < floor(floor(n * {_C_TEST!r}e0) * {_C_VAL!r}e0) THEN 'train'
  WHEN pos < floor(n * {_C_TEST!r}e0) THEN 'val' ELSE 'test' END AS split FROM pos""")
def chrono_split(spark, d):
    """70/15/15 chronological split over all cities (distributed positions, no global sort)."""
    return SP.chrono_split(merged(spark, d).select("city_name", "date"))


@query("ts_cv_folds", V("merged", extra=[("pos", _POS)]) + """
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date FROM (
  SELECT f.fold, date, CASE WHEN pos < n - (5 - f.fold) * floor(n / 6) THEN 'train'
         WHEN pos < n - (5 - f.fold) * floor(n / 6) + floor(n / 6) THEN 'test' END AS role
  FROM pos, (SELECT unnest(range(5)) AS fold) f) x WHERE role IS NOT NULL GROUP BY fold, role""")
def ts_cv_folds(spark, d):
    """S3: expanding-window 5-fold time-series CV, summarised per (fold, role)."""
    return SP.ts_cv_folds(merged(spark, d).select("city_name", "date"))


@query("temporal_split", V("merged") + """
SELECT city_name, date, CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '1999-07-01' THEN 'val'
  ELSE 'test' END AS split FROM merged""")
def temporal_split(spark, d):
    """Split by date bounds."""
    return SP.temporal_split(merged(spark, d).select("city_name", "date"), "1999-01-01", "1999-07-01")


@query("temporal_split_default", V("merged", extra=[("pos", _POS)]) + """
SELECT city_name, date, CASE WHEN pos < floor(n * 0.7e0) THEN 'train'
  WHEN pos < floor(n * 0.7e0) + floor((n - floor(n * 0.7e0)) * 0.5e0) THEN 'val' ELSE 'test' END AS split FROM pos""")
def temporal_split_default(spark, d):
    """S5 default: 70 % train, the rest halved."""
    return SP.temporal_split(merged(spark, d).select("city_name", "date"))


@query("eligible_cities", V("merged") + """
SELECT city_name, count(*) AS n_rows, count(pm25) AS n_target FROM merged GROUP BY city_name
HAVING count(*) >= 100 AND count(pm25) >= 100""")
def eligible_cities(spark, d):
    """Minimum-size guards (city rows >= 100, non-NULL target >= 100)."""
    return SP.eligible_cities(merged(spark, d))


def _ewm_sql(span):
    q = 1.0 - 2.0 / (span + 1.0)
    lst = "list({'p': pos, 'v': pm25}) OVER (PARTITION BY city_name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    pres = f"list_filter({lst}, lambda e: e.v IS NOT NULL)"
    last = f"max(CASE WHEN pm25 IS NOT NULL THEN pos END) OVER (PARTITION BY city_name ORDER BY date)"
    num = f"list_sum(list_transform({pres}, lambda e: pow({q!r}e0, {last} - e.p) * e.v))"
    den = f"list_sum(list_transform({pres}, lambda e: pow({q!r}e0, {last} - e.p)))"
    return f"{num} / {den} AS pm25_ewm{span}"


@query("ewm", V("merged", extra=[("mp", "SELECT *, row_number() OVER (PARTITION BY city_name ORDER BY date) AS pos "
                                        "FROM merged")]) +
       f"SELECT city_name, date, pm25, {_ewm_sql(3)}, {_ewm_sql(7)}, {_ewm_sql(14)} FROM mp",
       ["pm25", "pm25_ewm3", "pm25_ewm7", "pm25_ewm14"])
def ewm(spark, d):
    """Exponentially weighted means of PM2.5 with spans 3, 7 and 14 per city."""
    return ts.ewm_means(merged(spark, d).select("city_name", "date", "pm25"), "pm25", [3, 7, 14])
