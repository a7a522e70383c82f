"""Window operators: gap fill vectors, past-only rolling, leakage and city boundaries."""

import datetime as dt

from pyspark.sql import functions as F

from airshed.operators import timeseries as ts

GAPS = [None, 1.0, None, None, None, None, 6.0, None, None, None, None]


def _series(spark, values, city="A"):
    d0 = dt.date(2024, 1, 1)
    return spark.createDataFrame([(city, d0 + dt.timedelta(days=i), v) for i, v in enumerate(values)],
                                 "city_name string, date date, x double")


def test_time_interpolation_limit_3(spark):
    out = ts.interpolate_time_limit(_series(spark, GAPS), ["x"]).orderBy("date").collect()
    assert [r.x for r in out] == [None, 1.0, 2.0, 3.0, 4.0, None, 6.0, 6.0, 6.0, 6.0, None]
    assert [r.x_interpolated for r in out] == [False, False, True, True, True, False, False, True, True, True, False]


def test_linear_interpolation_edges_held(spark):
    out = ts.interpolate_linear(_series(spark, GAPS), ["x"]).orderBy("date").collect()
    assert [r.x for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0, 6.0, 6.0, 6.0]


def test_time_interpolation_uses_dates(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [("A", d0, 0.0), ("A", d0 + dt.timedelta(days=1), None), ("A", d0 + dt.timedelta(days=4), 8.0)]
    df = spark.createDataFrame(rows, "city_name string, date date, x double")
    out = ts.interpolate_time_limit(df, ["x"]).orderBy("date").collect()
    assert [r.x for r in out] == [0.0, 2.0, 8.0]


def test_rolling_is_past_only_and_per_city(spark):
    df = _series(spark, [1.0, 2.0, 3.0], "A").unionByName(_series(spark, [10.0, 20.0, 30.0], "B"))
    out = df.select("city_name", "date", *ts.rolling_columns(["x"], means=[2], stds=[])).orderBy("city_name", "date")
    assert [r.x_roll2_mean for r in out.collect()] == [None, 1.0, 1.5, None, 10.0, 15.0]


def test_lags_do_not_look_ahead(spark):
    base = _series(spark, [1.0, 2.0, 3.0, 4.0])
    changed = _series(spark, [1.0, 2.0, 3.0, 400.0])
    f = lambda d: [tuple(r) for r in d.select("date", *ts.lag_columns(["x"], lags=[1, 2], weather_lags=[]),
                                              *ts.rolling_columns(["x"], means=[2], stds=[2]))
                   .orderBy("date").collect()]
    a, b = f(base), f(changed)
    assert a[:3] == b[:3]


def test_streaks_and_days_since(spark):
    df = _series(spark, [40.0, 50.0, 10.0, 60.0, 70.0, 80.0])
    out = ts.streak_lengths(df, "x", 35.0).orderBy("date").collect()
    assert [r.high_streak for r in out] == [1, 2, 0, 1, 2, 3]
    assert [r.rise_streak for r in out] == [0, 1, 0, 1, 2, 3]
    ds = df.select("date", ts.days_since(F.col("x") > 55).alias("d")).orderBy("date").collect()
    assert [r.d for r in ds] == [None, None, None, None, 1, 1]


def test_interpolation_never_changes_present_values(spark):
    vals = [3.0, None, 7.0, None, None, 1.0, None]
    out = ts.interpolate_linear(_series(spark, vals), ["x"]).orderBy("date").collect()
    for v, r in zip(vals, out):
        if v is not None:
            assert r.x == v
