"""Cleaning operators: sentinels, units, canonical columns, range checks.

All are narrow projections (no shuffle); they fuse into the scan's
whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airshed.constants import (
    CLIP_RANGES,
    COVERAGE_COLS,
    DEFAULT_POLLUTANT_RANGE,
    GSOD_SENTINELS,
    POLLUTANT_RANGES,
    TARGET_CLIP,
    WEATHER_RANGES,
)
from airshed.functions.units import convert_to_target, f_to_c, inch_to_mm, knot_to_kmh, mile_to_km

# canonical GSOD column -> engine column
CANONICAL_WEATHER = [
    ("STATION", "station_id"),
    ("DATE", "date"),
    ("LATITUDE", "lat"),
    ("LONGITUDE", "lon"),
    ("ELEVATION", "elev_m"),
    ("TEMP_C", "temp_avg_c"),
    ("MAX_C", "temp_max_c"),
    ("MIN_C", "temp_min_c"),
    ("DEWP_C", "dewpoint_c"),
    ("PRCP_MM", "precip_mm"),
    ("WDSP_KMH", "wind_speed_kmh"),
    ("VISIB_KM", "visibility_km"),
    ("STP_HPA", "station_pressure_hpa"),
    ("FRSHTT", "weather_flags"),
]


def numeric(c: Column) -> Column:
    """Coerce to double, bad text -> NULL, NaN -> NULL (invariant: no NaN)."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def sentinel_null(df: DataFrame) -> DataFrame:
    """Exact per-column sentinel -> NULL."""
    cols = []
    for name in df.columns:
        if name in GSOD_SENTINELS:
            cols.append(F.nullif(F.col(name), F.lit(GSOD_SENTINELS[name])).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def unit_convert_weather(df: DataFrame) -> DataFrame:
    """Imperial -> metric; pressure = coalesce(SLP, STP) (sentinels already NULL)."""
    have = set(df.columns)
    extra = []
    if "TEMP" in have:
        extra += [f_to_c(F.col("TEMP")).alias("TEMP_C"), f_to_c(F.col("MAX")).alias("MAX_C"),
                  f_to_c(F.col("MIN")).alias("MIN_C"), f_to_c(F.col("DEWP")).alias("DEWP_C")]
    if "PRCP" in have:
        extra.append(inch_to_mm(F.col("PRCP")).alias("PRCP_MM"))
    if "WDSP" in have:
        extra.append(knot_to_kmh(F.col("WDSP")).alias("WDSP_KMH"))
    if "VISIB" in have:
        extra.append(mile_to_km(F.col("VISIB")).alias("VISIB_KM"))
    press = [F.col(c) for c in ("SLP", "STP") if c in have]
    if press:
        extra.append((F.coalesce(*press) if len(press) > 1 else press[0]).alias("STP_HPA"))
    return df.select("*", *extra)


def canonical_weather(df: DataFrame) -> DataFrame:
    """Select + rename to the engine's columns; absent source columns become typed NULLs."""
    have = set(df.columns)
    cols = []
    for src, dst in CANONICAL_WEATHER:
        if src in have:
            cols.append(F.col(src).alias(dst))
        elif dst == "weather_flags":
            cols.append(F.lit(None).cast("string").alias(dst))
        elif dst == "date":
            cols.append(F.lit(None).cast("date").alias(dst))
        elif dst == "station_id":
            cols.append(F.lit(None).cast("long").alias(dst))
        else:
            cols.append(F.lit(None).cast("double").alias(dst))
    return df.select(*cols)


def range_flag(c: Column, lo: float, hi: float) -> Column:
    """True when non-NULL and outside the closed range."""
    return F.coalesce(~c.between(F.lit(lo), F.lit(hi)), F.lit(False))


def outlier_weather(df: DataFrame) -> DataFrame:
    """Flag values outside plausibility ranges, then NULL them.  Flags always exist."""
    out = []
    flags = []
    for name in df.columns:
        if name in WEATHER_RANGES:
            lo, hi = WEATHER_RANGES[name]
            flag = range_flag(F.col(name), lo, hi)
            out.append(F.when(~flag, F.col(name)).alias(name))
            flags.append(flag.alias(f"{name}_is_outlier"))
        else:
            out.append(F.col(name))
    return df.select(*out, *flags)


def clean_gsod(raw: DataFrame) -> DataFrame:
    """sentinel -> units -> canonical -> outliers: one narrow projection."""
    return outlier_weather(canonical_weather(unit_convert_weather(sentinel_null(raw))))


def weather_flag_columns(flags: Column) -> list[Column]:
    """FRSHTT six-digit string -> fog, rain, snow, hail, thunder, tornado booleans."""
    names = ["fog", "rain", "snow", "hail", "thunder", "tornado"]
    return [(F.substring(flags, i + 1, 1) == "1").alias(f"has_{n}") for i, n in enumerate(names)]


# ---------------------------------------------------------------- air side
UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


def parse_air(raw: DataFrame) -> DataFrame:
    """Parse ISO timestamps with offsets (bad -> dropped), UTC day, numeric value, unit conversion.

    The filter only references the parsed timestamp and the coerced raw value (conversion never
    turns a value into NULL), so the optimizer does not copy the unit CASE into the predicate."""
    ts = F.try_to_timestamp(F.col("datetime"), F.lit(UTC_FORMAT))
    keep = [c for c in raw.columns if c != "value"]
    valid = raw.select(*keep, ts.alias("ts_utc"), numeric(F.col("value")).alias("_v")) \
        .where(F.col("ts_utc").isNotNull() & F.col("_v").isNotNull())
    return valid.select(*keep, "ts_utc", F.to_date("ts_utc").alias("date"),
                        convert_to_target(F.col("_v"), F.col("units"), F.col("parameter")).alias("value"))


def pollutant_range(parameter: Column) -> tuple[Column, Column]:
    lo = F.when(F.lit(False), F.lit(None).cast("double"))
    hi = F.when(F.lit(False), F.lit(None).cast("double"))
    for p, (a, b) in POLLUTANT_RANGES.items():
        lo = lo.when(parameter == p, F.lit(a))
        hi = hi.when(parameter == p, F.lit(b))
    return lo.otherwise(F.lit(DEFAULT_POLLUTANT_RANGE[0])), hi.otherwise(F.lit(DEFAULT_POLLUTANT_RANGE[1]))


def outlier_air(df: DataFrame, value: str = "value", parameter: str = "parameter") -> DataFrame:
    """Long-form range check: one expression for all pollutants, flag + NULL."""
    lo, hi = pollutant_range(F.col(parameter))
    flag = F.coalesce((F.col(value) < lo) | (F.col(value) > hi), F.lit(False))
    return df.select(*[F.when(~flag, F.col(value)).alias(value) if c == value else F.col(c) for c in df.columns],
                     flag.alias("is_outlier"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (greatest/least would otherwise skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(c, F.lit(hi))))


def clip_ranges(df: DataFrame, target: str | None = "pm25") -> DataFrame:
    cols = []
    for name in df.columns:
        if name in CLIP_RANGES:
            cols.append(clip(F.col(name), *CLIP_RANGES[name]).alias(name))
        elif target is not None and name == target:
            cols.append(clip(F.col(name), *TARGET_CLIP).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def coverage_filter(station_days: DataFrame, city_stations: DataFrame, min_coverage: float,
                    cols=COVERAGE_COLS) -> DataFrame:
    """Keep a (city, station) when the station's mean non-NULL share over ``cols`` >= min_coverage,
    or when the city has a single candidate station.  Coverage is one per-station aggregate
    (partial aggregation before the shuffle); the per-city count is a window over the small map."""
    from pyspark.sql import Window
    share = sum(F.avg(F.col(c).isNotNull().cast("double")) for c in cols) / F.lit(float(len(cols)))
    cov = station_days.groupBy("station_id").agg(share.alias("_coverage"))
    m = city_stations.select("*", F.count(F.lit(1)).over(Window.partitionBy("city_id")).alias("_n"))
    return cov.join(m, "station_id") \
        .where((F.col("_coverage") >= F.lit(min_coverage)) | (F.col("_n") == 1)).select(*city_stations.columns)

