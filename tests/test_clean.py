"""Sentinels, units, ranges, coercion on literal rows."""

from pyspark.sql import functions as F

from airshed.functions.units import convert_to_target
from airshed.operators import clean


def _gsod(spark):
    rows = [("A5125600451", "2025-01-01", 34.8, 22.6, 9999.9, 976.8, 9.8, 6.3, 42.8, 30.2, 0.0, "000000"),
            ("54511099999", "2025-08-23", 72.5, 67.0, 9999.9, 999.9, 6.7, 7.9, 90.0, 68.0, 0.15, "010000")]
    schema = ("STATION string, DATE string, TEMP double, DEWP double, SLP double, STP double, VISIB double, "
              "WDSP double, MAX double, MIN double, PRCP double, FRSHTT string")
    return spark.createDataFrame(rows, schema)


def test_gsod_literal_rows(spark):
    out = clean.clean_gsod(_gsod(spark)).orderBy("date").collect()
    r1, r2 = out
    assert round(r1.temp_avg_c, 4) == 1.5556
    assert r1.precip_mm == 0.0
    assert round(r1.wind_speed_kmh, 4) == 11.6676
    assert round(r1.visibility_km, 4) == 15.7715
    assert r1.station_pressure_hpa == 976.8
    assert round(r2.temp_avg_c, 4) == 22.5
    assert round(r2.precip_mm, 4) == 3.81
    assert r2.station_pressure_hpa is None
    assert r2.weather_flags == "010000"
    assert r1.lat is None  # absent source column -> typed NULL


def test_outlier_flag_then_null(spark):
    df = spark.createDataFrame([(70.0,), (20.0,), (None,)], "temp_avg_c double")
    got = [tuple(r) for r in clean.outlier_weather(df).collect()]
    assert got == [(None, True), (20.0, False), (None, False)]


def test_unit_conversion(spark):
    df = spark.createDataFrame([(40.0, "ppb", "no2"), (0.05, "mg/m³", "pm25"), (7.0, "foo", "pm25"),
                                (3.0, None, "o3"), (2.0, "ppm", "o3")], "v double, u string, p string")
    got = [r[0] for r in df.select(convert_to_target(F.col("v"), F.col("u"), F.col("p"))).collect()]
    assert [round(x, 6) for x in got] == [0.04, 50.0, 7.0, 3.0, 2.0]


def test_validation_frame_range_check(spark):
    pm = [35.0, 42.0, None, 55.0, 60.0, 9999.0, 45.0, 38.0, None, 50.0]
    df = spark.createDataFrame([(i, "pm25", v) for i, v in enumerate(pm)], "i int, parameter string, value double")
    out = clean.outlier_air(df)
    r = out.agg(F.sum(F.col("is_outlier").cast("int")), F.count("value"), F.max("value")).first()
    assert tuple(r) == (1, 7, 60.0)
    miss = df.agg((F.count("*") - F.count("value")) * 100.0 / F.count("*")).first()[0]
    assert miss == 20.0


def test_numeric_coercion_never_throws(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), (" 2 ",)], "s string")
    got = [r[0] for r in df.select(clean.numeric(F.col("s"))).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(50.0, 600.0), (None, None), (-40.0, -3.0)], "temp_avg_c double, pm25 double")
    got = [tuple(r) for r in clean.clip_ranges(df).collect()]
    assert got == [(45.0, 500.0), (None, None), (-30.0, 0.0)]
