"""Literal values of the published examples: newer PM2.5 bands, ozone by 1 hour and 8 hours."""

from pyspark.sql import functions as F

from airshed.functions import aqi as A


def test_pm25_2024_spot_values(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 9.0, 9.04, 9.1, 35.94, 55.4, 125.4, 225.4, 225.5, 325.4, 900.0, None)], "v double")
    got = [r[0] for r in df.select(A.aqi_pm25_2024("v")).collect()]
    assert got[:4] == [0, 50, 50, 51] and got[5:] == [150, 200, 300, 301, 500, 500, None]
    assert got[4] == 102  # 35.94 is truncated to 35.9


def test_ozone_takes_the_higher_scale(spark):
    df = spark.createDataFrame([(0.078533, 0.162), (0.078, 0.104), (0.050, 0.130), (None, 0.3)], "h8 double, h1 double")
    assert [r[0] for r in df.select(A.aqi_ozone(F.col("h8"), F.col("h1"))).collect()] == [147, 126, 107, 248]
