"""Registered queries: sources, cleaning, scalar functions, AQI."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airshed.constants import OZONE_1H_BREAKPOINTS, PM25_BREAKPOINTS_2024, POLLUTANTS, WEATHER_COLS
from airshed.functions import aqi as A
from airshed.operators import clean, merge, stations
from airshed.plans.oracle_views import with_views as V
from airshed.plans.pipeline import CityPipeline, hourly_parsed
from airshed.plans.registry import query
from airshed.plans.sqlgen import (
    advice_sql,
    aqi_by_parameter_sql,
    aqi_sql,
    category_sql,
    epa_trunc_sql,
    greatest_sql,
    primary_sql,
    short_advice_sql,
    snap_sql,
)
from airshed.sources import domain

RAW_W = ["TEMP", "MAX", "MIN", "DEWP", "VISIB", "WDSP", "PRCP", "SLP", "STP"]


# ------------------------------------------------------------------ sources
@query("scan_gsod", V("gsod_raw") + 'SELECT "STATION", "DATE", "TEMP", "MAX", "MIN", "DEWP", "VISIB", "WDSP", '
       '"PRCP", "SLP", "STP", "FRSHTT", "TEMP_ATTRIBUTES" FROM gsod_raw', RAW_W)
def scan_gsod(spark, d):
    """A1: typed scan of raw station observations (one scan, all stations and years)."""
    return domain.gsod_raw(spark, d).select("STATION", "DATE", *RAW_W, "FRSHTT", "TEMP_ATTRIBUTES")


@query("scan_openaq_archive", V("openaq_raw") + "SELECT location_id, datetime, parameter, units, value "
       "FROM openaq_raw WHERE parameter = 'pm25'", ["value"])
def scan_openaq_archive(spark, d):
    """A2: long-form archive rows filtered to one parameter (filter sits on the scan)."""
    return domain.openaq_raw(spark, d).where(F.col("parameter") == "pm25") \
        .select("location_id", "datetime", "parameter", "units", "value")


@query("safe_city", V("city") + "SELECT city_id, translate(city_name || ' x/y', ' /', '__') AS safe_name FROM city")
def safe_city(spark, d):
    """Path-safe city names."""
    return domain.cities(spark, d).select(
        "city_id", F.translate(F.concat(F.col("city_name"), F.lit(" x/y")), " /", "__").alias("safe_name"))


# ----------------------------------------------------------------- cleaning
@query("sentinel_null", V("gsod_raw") + "SELECT \"STATION\", \"DATE\", " + ", ".join(
    f'nullif("{c}", {v}e0) AS "{c}"' for c, v in
    [("TEMP", 9999.9), ("MAX", 9999.9), ("MIN", 9999.9), ("DEWP", 9999.9), ("VISIB", 999.9), ("WDSP", 999.9),
     ("PRCP", 99.99), ("SLP", 9999.9), ("STP", 999.9)]) + " FROM gsod_raw", RAW_W)
def sentinel_null(spark, d):
    """B1: exact per-column sentinel -> NULL."""
    return clean.sentinel_null(domain.gsod_raw(spark, d).select("STATION", "DATE", *RAW_W))


@query("unit_convert_weather", V("gsod_raw") + """
SELECT "STATION" AS station_id, "DATE" AS date,
       (nullif("TEMP", 9999.9e0) - 32e0) * 5e0 / 9e0 AS "TEMP_C",
       (nullif("MAX", 9999.9e0) - 32e0) * 5e0 / 9e0 AS "MAX_C",
       (nullif("MIN", 9999.9e0) - 32e0) * 5e0 / 9e0 AS "MIN_C",
       (nullif("DEWP", 9999.9e0) - 32e0) * 5e0 / 9e0 AS "DEWP_C",
       nullif("PRCP", 99.99e0) * 25.4e0 AS "PRCP_MM",
       nullif("WDSP", 999.9e0) * 1.852e0 AS "WDSP_KMH",
       nullif("VISIB", 999.9e0) * 1.60934e0 AS "VISIB_KM",
       coalesce(nullif("SLP", 9999.9e0), nullif("STP", 999.9e0)) AS "STP_HPA"
FROM gsod_raw""", ["TEMP_C", "MAX_C", "MIN_C", "DEWP_C", "PRCP_MM", "WDSP_KMH", "VISIB_KM", "STP_HPA"])
def unit_convert_weather(spark, d):
    """B2: imperial -> metric, pressure = coalesce(SLP, STP)."""
    df = clean.unit_convert_weather(clean.sentinel_null(domain.gsod_raw(spark, d)))
    return df.select(F.col("STATION").alias("station_id"), F.col("DATE").alias("date"), "TEMP_C", "MAX_C", "MIN_C",
                     "DEWP_C", "PRCP_MM", "WDSP_KMH", "VISIB_KM", "STP_HPA")


@query("canonical_weather", V("gsod_clean") + "SELECT station_id, date, weather_flags, " + ", ".join(
    f"{c}" for c in WEATHER_COLS) + ", CAST(NULL AS DOUBLE) AS lat FROM (" + """
  SELECT station_id, date, weather_flags, temp_avg_c, temp_max_c, temp_min_c, dewpoint_c, precip_mm,
         wind_speed_kmh, visibility_km, station_pressure_hpa FROM (
    SELECT "STATION" AS station_id, "DATE" AS date,
           (nullif("TEMP", 9999.9e0) - 32e0) * 5e0 / 9e0 AS temp_avg_c,
           (nullif("MAX", 9999.9e0) - 32e0) * 5e0 / 9e0 AS temp_max_c,
           (nullif("MIN", 9999.9e0) - 32e0) * 5e0 / 9e0 AS temp_min_c,
           (nullif("DEWP", 9999.9e0) - 32e0) * 5e0 / 9e0 AS dewpoint_c,
           nullif("PRCP", 99.99e0) * 25.4e0 AS precip_mm,
           nullif("WDSP", 999.9e0) * 1.852e0 AS wind_speed_kmh,
           nullif("VISIB", 999.9e0) * 1.60934e0 AS visibility_km,
           coalesce(nullif("SLP", 9999.9e0), nullif("STP", 999.9e0)) AS station_pressure_hpa,
           "FRSHTT" AS weather_flags FROM gsod_raw) a) b""", WEATHER_COLS + ["lat"])
def canonical_weather(spark, d):
    """Canonical column names; absent source columns (LATITUDE) become typed NULLs."""
    df = clean.canonical_weather(clean.unit_convert_weather(clean.sentinel_null(domain.gsod_raw(spark, d))))
    return df.select("station_id", "date", "weather_flags", *WEATHER_COLS, "lat")


_OUT_FLAGS = [f"{c}_is_outlier" for c in WEATHER_COLS if c != "dewpoint_c"]


@query("outlier_weather", V("gsod_clean") + "SELECT station_id, date, " + ", ".join(WEATHER_COLS + _OUT_FLAGS)
       + " FROM gsod_clean", WEATHER_COLS)
def outlier_weather(spark, d):
    """Closed-range check, flag then NULL (flags always present)."""
    return CityPipeline(spark, d).gsod_clean().select("station_id", "date", *WEATHER_COLS, *_OUT_FLAGS)


_FLAG_NAMES = ["fog", "rain", "snow", "hail", "thunder", "tornado"]


@query("weather_flags", V("gsod_raw") + 'SELECT "STATION" AS station_id, "DATE" AS date, ' + ", ".join(
    f"substring(\"FRSHTT\", {i + 1}, 1) = '1' AS has_{n}" for i, n in enumerate(_FLAG_NAMES)) + " FROM gsod_raw")
def weather_flags(spark, d):
    """FRSHTT string -> six booleans."""
    raw = domain.gsod_raw(spark, d)
    return raw.select(F.col("STATION").alias("station_id"), F.col("DATE").alias("date"),
                      *clean.weather_flag_columns(F.col("FRSHTT")))


@query("quality_predicates", V("gsod_raw") + """
SELECT "STATION" AS station_id, "DATE" AS date, t AS "TEMP", dw AS "DEWP", "TEMP_ATTRIBUTES" FROM (
  SELECT *, nullif("TEMP", 9999.9e0) AS t, nullif("DEWP", 9999.9e0) AS dw FROM gsod_raw) g
WHERE "TEMP_ATTRIBUTES" >= 4 AND dw <= t""", ["TEMP", "DEWP"])
def quality_predicates(spark, d):
    """Observation-quality predicates (>= 4 observations, dew point <= temperature)."""
    df = clean.sentinel_null(domain.gsod_raw(spark, d))
    return df.where((F.col("TEMP_ATTRIBUTES") >= 4) & (F.col("DEWP") <= F.col("TEMP"))) \
        .select(F.col("STATION").alias("station_id"), F.col("DATE").alias("date"), "TEMP", "DEWP", "TEMP_ATTRIBUTES")


@query("numeric_coerce", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN isnan(TRY_CAST(s AS DOUBLE)) THEN NULL ELSE TRY_CAST(s AS DOUBLE) END AS value
FROM (SELECT l_orderkey, l_linenumber,
             CASE WHEN l_linenumber = 3 THEN 'n/a' WHEN l_linenumber = 5 THEN ' ' || CAST(l_tax AS VARCHAR) || 'x'
                  ELSE CAST(l_quantity AS VARCHAR) END AS s FROM lineitem) t""", ["value"])
def numeric_coerce(spark, d):
    """Text -> double, bad text -> NULL (ANSI-safe try_cast)."""
    li = domain.table(spark, d, "lineitem")
    s = (F.when(F.col("l_linenumber") == 3, F.lit("n/a"))
         .when(F.col("l_linenumber") == 5, F.concat(F.lit(" "), F.col("l_tax").cast("string"), F.lit("x")))
         .otherwise(F.col("l_quantity").cast("string")))
    return li.select("l_orderkey", "l_linenumber", clean.numeric(s).alias("value"))


@query("active_stations", V("station") + """
SELECT station_id, lat, lon, end_ymd FROM station
WHERE lat IS NOT NULL AND lon IS NOT NULL AND end_ymd >= 20200000""", ["lat", "lon"])
def active_stations(spark, d):
    """Locatable stations active within two years of the reference year (2022)."""
    return stations.active_stations(domain.stations(spark, d), 2022).select("station_id", "lat", "lon", "end_ymd")


@query("station_key", V("station") + "SELECT station_id, lpad(usaf, 6, '0') || '-' || lpad(wban, 5, '0') AS station_key "
       "FROM station")
def station_key(spark, d):
    """USAF-WBAN key with zero padding."""
    return domain.stations(spark, d).select("station_id", stations.station_key(F.col("usaf"), F.col("wban"))
                                            .alias("station_key"))


# ---------------------------------------------------------------- air side
@query("unit_convert_air", V("air_parsed") + "SELECT location_id, parameter, units, row_key, row_line, ts_utc, value "
       "FROM air_parsed WHERE NOT is_outlier", ["value"])
def unit_convert_air(spark, d):
    """Every measurement in its pollutant's target unit (rows that pass the range check)."""
    p = CityPipeline(spark, d).air_parsed()
    return p.where(~F.col("is_outlier")).select("location_id", "parameter", "units", "row_key", "row_line",
                                                "ts_utc", "value")


@query("utc_day", V("openaq_raw") + """
SELECT location_id, row_key, row_line, ts_utc, CAST(ts_utc AS DATE) AS date FROM (
  SELECT *, CAST(try_strptime(datetime, '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts_utc
  FROM openaq_raw) a WHERE ts_utc IS NOT NULL""")
def utc_day(spark, d):
    """Parse ISO timestamps with mixed offsets, drop unparseable, UTC calendar day."""
    raw = domain.openaq_raw(spark, d)
    ts = F.try_to_timestamp(F.col("datetime"), F.lit(clean.UTC_FORMAT))
    return raw.select("location_id", "row_key", "row_line", ts.alias("ts_utc")) \
        .where(F.col("ts_utc").isNotNull()).select("*", F.to_date("ts_utc").alias("date"))


@query("outlier_air", V("air_parsed") + "SELECT location_id, parameter, row_key, row_line, value, is_outlier "
       "FROM air_parsed", ["value"])
def outlier_air(spark, d):
    """Long-form pollutant range check (one expression for all parameters)."""
    return CityPipeline(spark, d).air_parsed().select("location_id", "parameter", "row_key", "row_line",
                                                      "value", "is_outlier")


@query("daily_mean", V("air_parsed") + """
SELECT location_id, parameter, date, avg(value) AS value, count(value) AS n_obs
FROM air_parsed GROUP BY location_id, parameter, date""", ["value"])
def daily_mean(spark, d):
    """G1: daily mean per (location, pollutant) of unit-normalised values."""
    return merge.daily_mean_long(CityPipeline(spark, d).air_parsed())


# --------------------------------------------------------------------- AQI
def _aqi_long(df, epa=False):
    fn = A.aqi_epa if epa else A.aqi_strict
    expr = F.when(F.lit(False), F.lit(None).cast("int"))
    for p in POLLUTANTS:
        expr = expr.when(F.col("parameter") == p, fn(F.col("value"), p))
    return expr.otherwise(F.when(F.col("value").isNotNull(), F.lit(0)))


_DAILY_SQL = "SELECT location_id, parameter, date, avg(value) AS value FROM air_parsed GROUP BY location_id, parameter, date"


@query("aqi_strict", V("air_parsed", extra=[("dm", _DAILY_SQL)]) +
       f"SELECT location_id, parameter, date, value, {aqi_by_parameter_sql('value', 'parameter')} AS aqi FROM dm",
       ["value"])
def aqi_strict(spark, d):
    """AQI exactly as the published calculator (gaps and negatives -> 0, half-even)."""
    dm = merge.daily_mean_long(CityPipeline(spark, d).air_parsed()).drop("n_obs")
    return dm.select("*", _aqi_long(dm).alias("aqi"))


@query("aqi_epa", V("air_parsed", extra=[("dm", _DAILY_SQL)]) +
       f"SELECT location_id, parameter, date, value, {aqi_by_parameter_sql('value', 'parameter', epa=True)} AS aqi "
       "FROM dm", ["value"])
def aqi_epa(spark, d):
    """AQI after EPA truncation (o3 3 dp, pm25/co 1 dp, pm10 integer, so2/no2 whole ppb)."""
    dm = merge.daily_mean_long(CityPipeline(spark, d).air_parsed()).drop("n_obs")
    return dm.select("*", _aqi_long(dm, epa=True).alias("aqi"))


@query("aqi_pm25_2024", V("air_parsed", extra=[("dm", _DAILY_SQL)]) +
       f"SELECT location_id, date, value, {aqi_sql(epa_trunc_sql('value', 'pm25'), 'pm25', PM25_BREAKPOINTS_2024)} AS aqi "
       "FROM dm WHERE parameter = 'pm25'", ["value"])
def aqi_pm25_2024(spark, d):
    """F2: PM2.5 AQI by the newer bands."""
    dm = merge.daily_mean_long(CityPipeline(spark, d).air_parsed()).where("parameter = 'pm25'")
    return dm.select("location_id", "date", "value", A.aqi_pm25_2024("value").alias("aqi"))


_O3_HOUR = """
  SELECT location_id, CAST(floor(epoch(ts_utc) / 3600) AS BIGINT) AS hour_idx, avg(value) AS c FROM air_parsed
  WHERE parameter = 'o3' AND value IS NOT NULL GROUP BY 1, 2"""
_O3_DAY = """
  SELECT location_id, CAST(to_timestamp(hour_idx * 3600) AT TIME ZONE 'UTC' AS DATE) AS date, max(a8) AS max_8h, max(c) AS max_1h
  FROM (SELECT *, avg(c) OVER (PARTITION BY location_id ORDER BY hour_idx RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS a8
        FROM o3_hour) x GROUP BY 1, 2"""
_O3_1H = epa_trunc_sql("max_1h", "o3")


@query("aqi_ozone", V("air_parsed", extra=[("o3_hour", _O3_HOUR), ("o3_day", _O3_DAY)]) + f"""
SELECT location_id, date, max_8h, max_1h, greatest({aqi_sql(epa_trunc_sql('max_8h', 'o3'), 'o3')},
  CASE WHEN {snap_sql(_O3_1H)} >= 0.125e0 THEN {aqi_sql(_O3_1H, 'o3', OZONE_1H_BREAKPOINTS)} END) AS aqi FROM o3_day""",
       ["max_8h", "max_1h"])
def aqi_ozone(spark, d):
    """ozone AQI of each location-day, the higher of its 8-hour and its 1-hour maximum's."""
    rows = CityPipeline(spark, d).air_parsed().where((F.col("parameter") == "o3") & F.col("value").isNotNull())
    hours = rows.groupBy("location_id", F.floor(F.unix_timestamp("ts_utc") / 3600).cast("long").alias("hour_idx")).agg(F.avg("value").alias("c"))
    w = Window.partitionBy("location_id").orderBy("hour_idx").rangeBetween(-7, 0)
    day = F.to_date(F.timestamp_seconds(F.col("hour_idx") * 3600)).alias("date")
    days = hours.select("location_id", day, "c", F.avg("c").over(w).alias("a8")).groupBy("location_id", "date").agg(
        F.max("a8").alias("max_8h"), F.max("c").alias("max_1h"))
    return days.select("*", A.aqi_ozone(F.col("max_8h"), F.col("max_1h")).alias("aqi"))


_AQI_COLS = {p: f"{p}_aqi" for p in POLLUTANTS}
_CITY_AQI_SQL = ("SELECT city_id, date, " + ", ".join(POLLUTANTS) + ", " +
                 ", ".join(f"{aqi_sql(p, p)} AS {p}_aqi" for p in POLLUTANTS) + " FROM air_city")


def _city_aqi(spark, d):
    air = CityPipeline(spark, d).air_city_days().select("city_id", "date", *POLLUTANTS)
    return A.aqi_columns(air)


@query("aqi_overall", V("air_city", extra=[("ca", _CITY_AQI_SQL)]) +
       f"SELECT city_id, date, {', '.join(_AQI_COLS.values())}, {greatest_sql(list(_AQI_COLS.values()))} AS aqi "
       "FROM ca")
def aqi_overall(spark, d):
    """overall AQI = max over pollutant AQIs, NULLs skipped."""
    df = _city_aqi(spark, d)
    return df.select("city_id", "date", *_AQI_COLS.values(), A.overall_aqi(list(_AQI_COLS.values())).alias("aqi"))


@query("aqi_primary", V("air_city", extra=[("ca", _CITY_AQI_SQL)]) +
       f"SELECT city_id, date, {greatest_sql(list(_AQI_COLS.values()))} AS aqi, "
       f"{primary_sql(_AQI_COLS)} AS primary_pollutant FROM ca")
def aqi_primary(spark, d):
    """primary pollutant = arg-max AQI, first in column order on ties."""
    df = _city_aqi(spark, d)
    return df.select("city_id", "date", A.overall_aqi(list(_AQI_COLS.values())).alias("aqi"),
                     A.primary_pollutant(_AQI_COLS).alias("primary_pollutant"))


_OVERALL = f"SELECT city_id, date, {greatest_sql(list(_AQI_COLS.values()))} AS aqi FROM ca"


@query("aqi_category", V("air_city", extra=[("ca", _CITY_AQI_SQL), ("ov", _OVERALL)]) +
       f"SELECT city_id, date, aqi, {category_sql('aqi', 2)} AS label, {category_sql('aqi', 3)} AS color, "
       f"{category_sql('aqi', 4)} AS chinese, {category_sql('aqi', 5)} AS description FROM ov")
def aqi_category(spark, d):
    """category label/colour/Chinese/description by closed ranges (out of range -> Hazardous)."""
    df = _city_aqi(spark, d).select("city_id", "date", A.overall_aqi(list(_AQI_COLS.values())).alias("aqi"))
    return df.select("*", A.category("aqi", 2).alias("label"), A.category("aqi", 3).alias("color"),
                     A.category("aqi", 4).alias("chinese"), A.category("aqi", 5).alias("description"))


@query("health_advice", V("air_city", extra=[("ca", _CITY_AQI_SQL), ("ov", _OVERALL),
                                             ("lab", f"SELECT *, {category_sql('aqi', 2)} AS label FROM ov")]) +
       f"SELECT city_id, date, aqi, label, {advice_sql('label', 1)} AS message, "
       f"{advice_sql('label', 5)} || ' ' || {advice_sql('label', 1)} || chr(10) || '健康影响: ' || "
       f"{advice_sql('label', 2)} || chr(10) || '建议: ' || {advice_sql('label', 3)} AS advice_text, "
       f"{short_advice_sql('label')} AS short_advice FROM lab")
def health_advice(spark, d):
    """advice record, formatted text and the short advice line per city-day
    (unknown category -> Good for the record, '未知' for the short line)."""
    df = _city_aqi(spark, d).select("city_id", "date", A.overall_aqi(list(_AQI_COLS.values())).alias("aqi"))
    lab = A.category("aqi", 2)
    text = F.concat(A.advice_field(lab, 5), F.lit(" "), A.advice_field(lab, 1), F.lit("\n健康影响: "),
                    A.advice_field(lab, 2), F.lit("\n建议: "), A.advice_field(lab, 3))
    return df.select("city_id", "date", "aqi", lab.alias("label"), A.advice_field(lab, 1).alias("message"),
                     text.alias("advice_text"), A.short_advice(F.col("aqi")).alias("short_advice"))


_CAT_ROWS = " UNION ALL ".join(
    f"SELECT {c[0]} AS aqi_low, {c[1]} AS aqi_high, '{c[2]}' AS label" for c in A.AQI_CATEGORIES)


@query("aqi_advice_join", V("air_city", extra=[("ca", _CITY_AQI_SQL), ("ov", _OVERALL), ("cat", _CAT_ROWS)]) +
       "SELECT o.city_id, o.date, o.aqi, c.label FROM ov o JOIN cat c ON o.aqi BETWEEN c.aqi_low AND c.aqi_high")
def aqi_advice_join(spark, d):
    """Range join of AQI values with the 6-row category dimension (broadcast, fixed size)."""
    df = _city_aqi(spark, d).select("city_id", "date", A.overall_aqi(list(_AQI_COLS.values())).alias("aqi"))
    cat = spark.createDataFrame([(c[0], c[1], c[2]) for c in A.AQI_CATEGORIES], "aqi_low int, aqi_high int, label string")
    j = df.join(F.broadcast(cat), (df.aqi >= cat.aqi_low) & (df.aqi <= cat.aqi_high))
    return j.select("city_id", "date", "aqi", "label")


# ------------------------------------------------- flagship (hourly feed)
_HOURLY_DAILY = ("SELECT location_id, CAST(ts AS DATE) AS date, avg(pm25) AS pm25, count(*) AS n_hours "
                 "FROM hourly GROUP BY location_id, CAST(ts AS DATE)")


def hourly_daily_aqi_df(spark, d):
    h = hourly_parsed(spark, d)
    daily = h.groupBy("location_id", "date").agg(F.avg("pm25").alias("pm25"), F.count("*").alias("n_hours"))
    a = daily.select("*", A.aqi_strict(F.col("pm25"), "pm25").alias("aqi"))
    return a.select("*", A.category("aqi").alias("category"))


@query("hourly_daily_aqi", V("hourly", extra=[("dd", _HOURLY_DAILY)]) +
       f"SELECT *, {category_sql('aqi')} AS category FROM (SELECT *, {aqi_sql('pm25', 'pm25')} AS aqi FROM dd) x",
       ["pm25"])
def hourly_daily_aqi(spark, d):
    """Minimum slice: hourly PM2.5 -> daily mean -> AQI -> category."""
    return hourly_daily_aqi_df(spark, d)


@query("worst_days", V("hourly", extra=[("dd", _HOURLY_DAILY)]) + f"""
SELECT location_id, date, pm25, aqi, {category_sql('aqi')} AS category, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY aqi DESC, pm25 DESC, date) AS rk FROM (
    SELECT *, {aqi_sql('pm25', 'pm25')} AS aqi FROM dd) x) y WHERE rk <= 3""", ["pm25"])
def worst_days(spark, d):
    """S6 per group: the three worst days per location (top-k is the feature)."""
    from pyspark.sql import Window
    a = hourly_daily_aqi_df(spark, d)
    w = Window.partitionBy("location_id").orderBy(F.col("aqi").desc(), F.col("pm25").desc(), F.col("date"))
    return a.select("location_id", "date", "pm25", "aqi", "category", F.row_number().over(w).alias("rk")) \
        .where(F.col("rk") <= 3)


_BP_ROWS = " UNION ALL ".join(
    f"SELECT '{p}' AS pollutant, {b} AS band, {c_lo!r}e0 AS c_low, {c_hi!r}e0 AS c_high, {i_lo} AS i_low, {i_hi} AS i_high"
    for p, b, c_lo, c_hi, i_lo, i_hi in A.breakpoint_rows())


@query("aqi_breakpoint_join", V("air_parsed", extra=[("dm", _DAILY_SQL), ("bp", _BP_ROWS)]) + """
SELECT dm.location_id, dm.parameter, dm.date, dm.value, bp.band,
  CAST(round_even((bp.i_high - bp.i_low) / (bp.c_high - bp.c_low) * (floor(dm.value * 1e9 + 0.5e0) / 1e9 - bp.c_low)
       + bp.i_low, 0) AS INTEGER) AS band_aqi
FROM dm LEFT JOIN bp ON dm.parameter = bp.pollutant
  AND floor(dm.value * 1e9 + 0.5e0) / 1e9 BETWEEN bp.c_low AND bp.c_high""", ["value"])
def aqi_breakpoint_join(spark, d):
    """The 33-row breakpoint table as data -- a broadcast range join of daily means with
    their band (no band = a gap or above the table) and the in-band AQI."""
    from airshed.functions.units import snap
    dm = merge.daily_mean_long(CityPipeline(spark, d).air_parsed()).drop("n_obs")
    bp = spark.createDataFrame(A.breakpoint_rows(),
                               "pollutant string, band int, c_low double, c_high double, i_low int, i_high int")
    v = snap(F.col("value"))
    j = dm.join(F.broadcast(bp), (dm.parameter == bp.pollutant) & v.between(bp.c_low, bp.c_high), "left")
    slope = (F.col("i_high") - F.col("i_low")) / (F.col("c_high") - F.col("c_low"))
    return j.select("location_id", "parameter", "date", "value", "band",
                    F.rint(slope * (v - F.col("c_low")) + F.col("i_low")).cast("int").alias("band_aqi"))
