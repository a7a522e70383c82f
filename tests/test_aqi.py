"""AQI spot values (hand-computed from the published bands and formula)."""

import pytest
from pyspark.sql import functions as F

from airshed.functions import aqi as A

PM25_SPOTS = [(0.0, 0), (10.0, 42), (12.0, 50), (12.05, 0), (35.0, 99), (35.2, 100), (35.45, 0), (35.5, 101),
              (75.0, 161), (150.0, 200), (250.0, 300), (500.4, 500), (900.0, 500), (-1.0, 0)]


def test_pm25_spots(spark):
    df = spark.createDataFrame([(c,) for c, _ in PM25_SPOTS], "c double")
    got = [r[0] for r in df.select(A.aqi_strict(F.col("c"), "pm25")).collect()]
    assert got == [a for _, a in PM25_SPOTS]


def test_null_stays_null_and_unknown_pollutant(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "c double")
    got = [tuple(r) for r in df.select(A.aqi_strict(F.col("c"), "pm25"), A.aqi_strict(F.col("c"), "xyz")).collect()]
    assert got == [(None, None), (21, 0)]  # 5 * 50 / 12 = 20.83 -> 21


def test_epa_doc_examples(spark):
    df = spark.createDataFrame([(0.07853333, 35.9, 8.4)], "o3 double, pm25 double, co double")
    r = df.select(A.aqi_epa(F.col("o3"), "o3").alias("o3"), A.aqi_epa(F.col("pm25"), "pm25").alias("pm25"),
                  A.aqi_epa(F.col("co"), "co").alias("co")).first()
    assert (r.o3, r.pm25, r.co) == (126, 102, 90)
    ov = df.select(A.aqi_epa(F.col("o3"), "o3").alias("o3_aqi"), A.aqi_epa(F.col("pm25"), "pm25").alias("pm25_aqi"),
                   A.aqi_epa(F.col("co"), "co").alias("co_aqi"))
    out = ov.select(A.overall_aqi(["o3_aqi", "pm25_aqi", "co_aqi"]).alias("a"),
                    A.primary_pollutant({"o3": "o3_aqi", "pm25": "pm25_aqi", "co": "co_aqi"}).alias("p")).first()
    assert (out.a, out.p) == (126, "o3")


@pytest.mark.parametrize("aqi,label", [(0, "Good"), (50, "Good"), (51, "Moderate"), (100, "Moderate"),
                                       (101, "Unhealthy for Sensitive Groups"), (200, "Unhealthy"),
                                       (300, "Very Unhealthy"), (500, "Hazardous"), (999, "Hazardous"),
                                       (None, "Unknown")])
def test_categories(spark, aqi, label):
    df = spark.createDataFrame([(aqi,)], "a int")
    assert df.select(A.category("a")).first()[0] == label


def test_advice_defaults_to_good(spark):
    df = spark.createDataFrame([("Nope",), ("Hazardous",)], "l string")
    got = [r[0] for r in df.select(A.advice_field(F.col("l"), 3)).collect()]
    assert got == ["正常活动", "留在室内，使用空气净化器"]


def test_aqi_monotone_inside_bands(spark):
    vals = [i / 10 for i in range(0, 120)]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    got = [r[0] for r in df.orderBy("c").select(A.aqi_strict(F.col("c"), "pm25")).collect()]
    assert got == sorted(got)
