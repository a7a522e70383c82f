"""Registered queries: JSON records, flattening, sensor lookup, sinks, reports, code mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from airshed.constants import PARAMETER_IDS, POLLUTANTS, WEATHER_COLS
from airshed.operators import merge
from airshed.plans.oracle_views import with_views as V
from airshed.plans.pipeline import CityPipeline, stored_merged
from airshed.plans.registry import query
from airshed.plans.sqlgen import snap_sql as S
from airshed.sources import domain, readers, sinks


def _measurement_json(spark, d):
    """Measurement records as the API delivers them (JSON text), derived from the hourly feed:
    'view' events report mg/m3, 'signup' events carry no period, props.k % 10 == 0 has no value."""
    h = domain.hourly(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    mg = F.col("event_type") == "view"
    value = F.when(k % 10 == 0, F.lit(None).cast("double")) \
        .when(mg, F.col("pm25") / F.lit(1000.0)).otherwise(F.col("pm25"))
    period = F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.struct(
        F.lit("1hour").alias("label"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetimeFrom")))
    rec = F.struct(value.alias("value"),
                   F.struct(F.lit(PARAMETER_IDS["pm25"]).alias("id"), F.lit("pm25").alias("name"),
                            F.when(mg, F.lit("mg/m³")).otherwise(F.lit("µg/m³")).alias("units")).alias("parameter"),
                   period.alias("period"))
    return h.select("event_id", "location_id", F.to_json(rec).alias("json"))


_MEAS_SQL = """
SELECT event_id, location_id, CAST(ts AS DATE) AS date, CASE WHEN event_type = 'view' THEN (pm25 / 1000e0) * 1000e0
  ELSE pm25 END AS value, 'pm25' AS parameter FROM hourly
WHERE event_type <> 'signup' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0"""


@query("parse_measurements_json", V("hourly") + _MEAS_SQL, ["value"])
def parse_measurements_json(spark, d):
    """A3: JSON measurement records parsed with an explicit nested schema; date = first 10
    characters of period.datetimeFrom.utc; rows without date or value dropped; units converted."""
    from airshed.functions.units import convert_to_target
    j = _measurement_json(spark, d)
    parsed = j.select("event_id", "location_id", F.from_json("json", readers.MEASUREMENT_SCHEMA).alias("m"))
    rows = parsed.select("event_id", "location_id", F.substring("m.period.datetimeFrom.utc", 1, 10).alias("dt"),
                         F.col("m.value").alias("v"), F.col("m.parameter.name").alias("parameter"),
                         F.col("m.parameter.units").alias("units"))
    rows = rows.where(F.col("dt").isNotNull() & F.col("v").isNotNull())
    return rows.select("event_id", "location_id", F.to_date("dt").alias("date"),
                       convert_to_target(F.col("v"), F.col("units"), F.col("parameter")).alias("value"), "parameter")


@query("flatten_struct", V("hourly") + """
SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
  WHEN event_type = 'view' THEN pm25 / 1000e0 ELSE pm25 END AS value,
  2 AS parameter_id, 'pm25' AS parameter_name,
  CASE WHEN event_type = 'view' THEN 'mg/m³' ELSE 'µg/m³' END AS parameter_units,
  CASE WHEN event_type = 'signup' THEN NULL ELSE '1hour' END AS period_label,
  CASE WHEN event_type = 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS period_datetimeFrom_utc
FROM hourly""", ["value"])
def flatten_struct(spark, d):
    """A4: nested record -> flat a_b_c columns (json_normalize semantics)."""
    j = _measurement_json(spark, d)
    sch = "value double, parameter struct<id:int,name:string,units:string>, " \
          "period struct<label:string,datetimeFrom:struct<utc:string>>"
    parsed = j.select("event_id", F.from_json("json", sch).alias("m")).select("event_id", "m.*")
    return readers.flatten(parsed)


_PID = " UNION ALL ".join(f"SELECT '{p}' AS parameter, {i} AS parameter_id" for p, i in PARAMETER_IDS.items())


@query("sensor_lookup", V("openaq_raw", extra=[("pid", _PID)]) + """
SELECT DISTINCT o.location_id, o.parameter, o.location_id * 100 + p.parameter_id AS sensor_id
FROM openaq_raw o JOIN pid p ON o.parameter = p.parameter""")
def sensor_lookup(spark, d):
    """A5: location records carry a sensors array (id, parameter struct); explode it, match the
    parameter id map and keep the first sensor per (location, parameter)."""
    raw = domain.openaq_raw(spark, d)
    pid = spark.createDataFrame(list(PARAMETER_IDS.items()), "parameter string, parameter_id int")
    sensors = raw.select("location_id", "parameter").distinct().join(F.broadcast(pid), "parameter").select(
        "location_id", F.struct((F.col("location_id") * 100 + F.col("parameter_id")).alias("id"),
                                F.col("parameter").alias("name"),
                                F.struct(F.col("parameter_id").alias("id"), F.col("parameter").alias("name"))
                                .alias("parameter")).alias("s"))
    # one record per location; the array is bounded by the number of parameters (6)
    locations = sensors.groupBy(F.col("location_id").alias("id")).agg(
        F.array_sort(F.collect_set("s")).alias("sensors"))
    return readers.sensors_for(locations, pid).select("location_id", "parameter", "sensor_id")


_R2 = WEATHER_COLS + POLLUTANTS


@query("write_city_year", V("merged") + "SELECT city_name, date, " + ", ".join(
    f"round_even({S(c)} * 100e0, 0) / 100e0 AS {c}" for c in _R2) +
       ", translate(city_name, ' /', '__') AS city_part, year FROM merged", _R2)
def write_city_year(spark, d):
    """Per-city, per-year sink (partitioned table, 2-dp rounding, dynamic partition
    overwrite so re-runs are idempotent); returns the table read back."""
    m = stored_merged(spark, d)
    path = sinks.default_path(m, "city_year")
    sinks.write_city_year(m, path)
    return spark.read.parquet(path)


_AIR_FIN = ", ".join(f"round_even({S(p)} * 100e0, 0) / 100e0 AS {p}, CAST({p}_source_count AS BIGINT) AS {p}_source_count"
                     for p in POLLUTANTS)


@query("finalize_air", V("air_city") + f"""
SELECT CAST(city_id AS BIGINT) AS city_id, date, {_AIR_FIN}, CAST(station_count AS BIGINT) AS station_count, data_source,
  least(greatest(data_quality_score, 0e0), 1e0) AS data_quality_score FROM air_city""",
       POLLUTANTS + ["data_quality_score"])
def finalize_air(spark, d):
    """Drop unit columns, 2-dp floats, long counts, quality score clipped to [0, 1]."""
    a = CityPipeline(spark, d).air_city_days()
    a = merge.air_units(a.select("city_id", "date", *POLLUTANTS, *[f"{p}_source_count" for p in POLLUTANTS],
                                 "station_count", "data_source", "data_quality_score"))
    return sinks.finalize_air(a)


@query("weather_report", V("weather_city") + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, count({c}) AS count, count({c}) * 100e0 / count(*) AS coverage_pct, avg({c}) AS mean, "
    f"min({c}) AS min, max({c}) AS max, min(date) AS start_date, max(date) AS end_date FROM weather_city"
    for c in WEATHER_COLS), ["coverage_pct", "mean", "min", "max"])
def weather_report(spark, d):
    """Weather quality report (non-NULL count, coverage %, mean, min, max, date range)."""
    return sinks.quality_report(CityPipeline(spark, d).weather_city_days(), WEATHER_COLS)


_RES = ["val_rmse", "val_mae", "val_r2", "test_rmse", "test_mae", "test_r2"]


@query("results_sink", V("experiment_results") + """
SELECT *, CAST(row_number() OVER (PARTITION BY mode ORDER BY val_rmse, algorithm, city_id) AS INTEGER) AS rank
FROM experiment_results""", _RES)
def results_sink(spark, d):
    """Every result ranked within its mode (JSON lines), with a manifest and the best
    configuration of each mode beside it; the results are read back with their schema."""
    from pyspark.sql import Window
    r = domain.experiment_results(spark, d)
    w = Window.partitionBy("mode").orderBy("val_rmse", "algorithm", "city_id")
    ranked = r.select("*", F.row_number().over(w).alias("rank"))
    path = sinks.default_path(r, "results")
    sinks.write_results(ranked, f"{path}/results", "json")
    back = spark.read.schema(ranked.schema).json(f"{path}/results")
    sinks.write_results(back.groupBy("mode").agg(F.count(F.lit(1)).alias("results"), F.min("val_rmse").alias("best_val_rmse")), f"{path}/manifest", "json")
    sinks.write_results(back.where("rank = 1"), f"{path}/best", "json")
    return back


_FIPS = """
  SELECT r_regionkey, upper(substr(r_name, 1, 2)) AS fips, 'C' || CAST(r_regionkey AS VARCHAR) AS iso2 FROM region"""


@query("country_code_join", V("station", extra=[("codes", _FIPS)]) + """
SELECT s.station_id, k.fips AS ctry_fips, k.iso2, n.n_cities
FROM station s JOIN nation nt ON s.home_city_id = nt.n_nationkey
JOIN codes k ON nt.n_regionkey = k.r_regionkey
JOIN (SELECT iso2, count(*) AS n_cities FROM city GROUP BY iso2) n ON n.iso2 = k.iso2""")
def country_code_join(spark, d):
    """Station country codes (FIPS-style, from the region name) reconciled to the city
    catalogue's ISO codes through a mapping table (bounded dimension, broadcast)."""
    st = domain.stations(spark, d)
    nat = domain.table(spark, d, "nation").select(F.col("n_nationkey").alias("home_city_id"), "n_regionkey")
    codes = domain.table(spark, d, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.upper(F.substring("r_name", 1, 2)).alias("ctry_fips"),
        F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("iso2"))
    n = domain.cities(spark, d).groupBy("iso2").agg(F.count("*").cast("long").alias("n_cities"))
    return st.join(nat, "home_city_id").join(F.broadcast(codes), "n_regionkey").join(F.broadcast(n), "iso2") \
        .select("station_id", "ctry_fips", "iso2", "n_cities")
