"""Multi-station merging, pollutant pivot, weather-air join, calendar spine.

Shape of the plan (E1): station-day rows are hash-partitioned once by
``(city_id, date)``; the inverse-distance weighting is a plain aggregate of
sums (partial aggregation happens before the shuffle); the weather and air
aggregates come out partitioned on the same keys, so the final left join
needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airshed.constants import (
    IDW_DEFAULT_KM,
    IDW_DEFAULT_M,
    IDW_MIN_KM,
    IDW_MIN_M,
    POLLUTANT_UNITS,
    POLLUTANTS,
    WEATHER_COLS,
)


def weather_station_days(clean: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per (station, day): several raw rows of a day are averaged (NULLs skipped),
    outlier flags OR-ed; station coordinates come from the catalogue.  Only fixed-width
    buffers (doubles, booleans), so the aggregate stays a hash aggregate."""
    aggs = [F.avg(c).alias(c) for c in WEATHER_COLS]
    aggs += [F.max(F.col(f"{c}_is_outlier")).alias(f"{c}_is_outlier") for c in WEATHER_COLS
             if f"{c}_is_outlier" in clean.columns]
    days = clean.groupBy("station_id", "date").agg(*aggs)
    coords = stations.select("station_id", F.col("lat"), F.col("lon"), F.col("elev_m"))
    return days.join(coords, "station_id", "left")


def air_location_days(parsed: DataFrame) -> DataFrame:
    """Daily mean per (location, day) for the six pollutants in wide form (one shuffle).

    ``parsed`` is long form after unit conversion and the hourly range check."""
    aggs = []
    for p in POLLUTANTS:
        is_p = F.col("parameter") == p
        aggs.append(F.avg(F.when(is_p, F.col("value"))).alias(p))
        aggs.append(F.max(F.when(is_p, F.col("is_outlier"))).alias(f"{p}_is_outlier"))
    return parsed.groupBy("location_id", "date").agg(*aggs)


def daily_mean_long(parsed: DataFrame) -> DataFrame:
    """G1 in long form: (location, parameter, day) -> mean, observations."""
    return parsed.groupBy("location_id", "parameter", "date").agg(
        F.avg("value").alias("value"), F.count("value").cast("long").alias("n_obs"))


def _idw(rows: DataFrame, cols: list[str], weight: Column, key: str, outlier_cols: bool) -> DataFrame:
    """Weighted mean per (city, day) with NULL-skipping, renormalised weights.

    Single-station cities keep their values (source counts 1, quality 1.0)."""
    w = weight
    aggs = []
    for c in cols:
        aggs.append((F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c))
        aggs.append(F.count(c).cast("long").alias(f"{c}_source_count"))
        if outlier_cols and f"{c}_is_outlier" in rows.columns:
            aggs.append(F.coalesce(F.max(f"{c}_is_outlier"), F.lit(False)).alias(f"{c}_is_outlier"))
    aggs.append(F.count("*").cast("long").alias("station_count"))
    aggs.append(F.max("n_city_stations").alias("n_city_stations"))
    if "lat" in rows.columns:
        # three scalar min_by's (fixed-width buffers keep this a hash aggregate); the ordering key
        # (rank within the city) is unique, so all three come from the same station
        located = F.when(F.col("lat").isNotNull(), F.col("rank"))
        aggs += [F.min_by(c, located).alias(f"_loc_{c}") for c in ("lat", "lon", "elev_m")]
    g = rows.groupBy("city_id", "date").agg(*aggs)
    single = F.col("n_city_stations") == 1
    valid = sum(F.col(c).isNotNull().cast("int") for c in cols)
    out = [F.col("city_id"), F.col("date")]
    for c in cols:
        out.append(F.col(c))
        out.append(F.when(single, F.lit(1).cast("long")).otherwise(F.col(f"{c}_source_count"))
                   .alias(f"{c}_source_count"))
        if outlier_cols and f"{c}_is_outlier" in rows.columns:
            out.append(F.col(f"{c}_is_outlier"))
    if "lat" in rows.columns:
        out += [F.col(f"_loc_{c}").alias(c) for c in ("lat", "lon", "elev_m")]
    out += [
        F.col("station_count"),
        F.when(single, F.lit("single_station")).otherwise(F.lit("weighted_average")).alias("data_source"),
        F.when(single, F.lit(1.0)).otherwise(valid / F.lit(float(len(cols)))).alias("data_quality_score"),
    ]
    return g.select(*out)


def with_city_station_count(city_map: DataFrame) -> DataFrame:
    """Stations per city as a window over the (small, city-partitioned) map.

    No broadcast hint: the planner broadcasts the map where its size is under the threshold."""
    return city_map.select("*", F.count(F.lit(1)).over(Window.partitionBy("city_id")).alias("n_city_stations"))


def idw_weather(station_days: DataFrame, city_map: DataFrame) -> DataFrame:
    """Weather: w = 1 / max(km, 0.1), unknown distance -> 1 km."""
    m = with_city_station_count(city_map)
    rows = station_days.join(m, "station_id")
    km = F.coalesce(F.col("distance_km"), F.lit(IDW_DEFAULT_KM))
    weight = F.lit(1.0) / F.greatest(km, F.lit(IDW_MIN_KM))
    return _idw(rows, WEATHER_COLS, weight, "station_id", outlier_cols=True)


def idw_air(location_days: DataFrame, city_map: DataFrame) -> DataFrame:
    """Air: w = 1 / max(m, 100), unknown distance -> 1000 m."""
    m = with_city_station_count(city_map.withColumnRenamed("station_id", "location_id"))
    rows = location_days.join(m, "location_id")
    metres = F.coalesce(F.col("distance_km") * F.lit(1000.0), F.lit(IDW_DEFAULT_M))
    weight = F.lit(1.0) / F.greatest(metres, F.lit(IDW_MIN_M))
    return _idw(rows.drop("lat"), POLLUTANTS, weight, "location_id", outlier_cols=True)


def normalise_city_name(c: Column) -> Column:
    return F.regexp_replace(c, "_", " ")


def merge_daily(weather: DataFrame, air: DataFrame, cities: DataFrame) -> DataFrame:
    """Weather LEFT JOIN air on (city, date); bookkeeping columns dropped, names normalised,
    missing pollutant columns present as NULL."""
    keep_w = ["city_id", "date"] + WEATHER_COLS
    w = weather.select(*[c for c in keep_w if c in weather.columns])
    a = air.select("city_id", "date", *[c for c in POLLUTANTS if c in air.columns])
    j = w.join(a, ["city_id", "date"], "left")
    for p in POLLUTANTS:
        if p not in j.columns:
            j = j.withColumn(p, F.lit(None).cast("double"))
    names = cities.select("city_id", normalise_city_name(F.col("city_name")).alias("city_name"))
    return j.join(names, "city_id").select(
        "city_name", "date", *WEATHER_COLS, *POLLUTANTS, F.year("date").alias("year"))


def fill_missing_dates(df: DataFrame, key: str = "city_name", date: str = "date",
                       start: str | None = None, end: str | None = None,
                       mode_cols: list[str] | None = None) -> DataFrame:
    """Calendar spine per key (``start``..``end`` or the key's own min..max) LEFT JOIN data.

    Metadata columns in ``mode_cols`` are filled with the key's most frequent value
    (ties -> smallest), computed with one aggregate."""
    bounds = df.groupBy(key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    lo = F.lit(start).cast("date") if start else F.col("_lo")
    hi = F.lit(end).cast("date") if end else F.col("_hi")
    spine = bounds.select(key, F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))).alias(date))
    out = spine.join(df, [key, date], "left")
    if mode_cols:
        modes = df.groupBy(key).agg(*[F.mode(c, deterministic=True).alias(f"_mode_{c}") for c in mode_cols])
        out = out.join(modes, key, "left").select(
            *[F.coalesce(F.col(c), F.col(f"_mode_{c}")).alias(c) if c in mode_cols else F.col(c)
              for c in out.columns if not c.startswith("_mode_")])
    return out


def air_units(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(POLLUTANT_UNITS[p]).alias(f"{p}_unit") for p in POLLUTANTS])
