"""No cuts, no size switches: EWM over gaps, grid join at the date line, large values, stored tables."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airshed.functions.geo import haversine_km
from airshed.functions.units import snap
from airshed.operators import stations as ST
from airshed.operators import timeseries as ts
from airshed.plans import pipeline as P
from airshed.plans.finish import finish


def test_ewm_equals_pandas_over_long_gaps(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 200, 500)
    x[3:203] = np.nan
    x[300:302] = np.nan
    x[0] = 5.0
    days = pd.date_range("2020-01-01", periods=500).date
    rows = [("a", d, None if math.isnan(v) else float(v)) for d, v in zip(days, x)] + [("b", days[0], None), ("b", days[1], 7.0), ("c", days[0], None)]
    df = spark.createDataFrame(rows, "city_name string, date date, pm25 double")
    got = ts.ewm_means(df, "pm25", [3, 7, 14]).toPandas().sort_values(["city_name", "date"])
    for s in (3, 7, 14):
        want = pd.Series(x).ewm(span=s, adjust=True).mean()
        own = got[got.city_name == "a"][f"pm25_ewm{s}"].to_numpy()
        assert np.allclose(own, want, rtol=1e-12) and not np.isnan(own).any()
        assert got[got.city_name == "b"][f"pm25_ewm{s}"].tolist()[1] == 7.0


@pytest.mark.parametrize("radius", [25.0, 50.0, 100.0])
def test_grid_join_around_the_date_line(spark, radius):
    lons = [179.0 + 0.04 * k for k in range(26)] + [-180.0 + 0.04 * k for k in range(26)]
    cities = spark.createDataFrame([(k, la, lo) for k, (la, lo) in enumerate((la, lo) for la in (-60.0, 0.0, 45.0) for lo in lons)], "city_id int, lat double, lng double")
    stations = spark.createDataFrame([(k, la + 0.1, lo + 0.013) for k, (la, lo) in enumerate((la, lo) for la in (-60.0, 0.0, 45.0) for lo in lons)], "station_id int, lat double, lon double")
    got = {(r[0], r[1]) for r in ST.within_radius(cities, stations, radius).select("city_id", "station_id").collect()}
    s = stations.select("station_id", F.col("lat").alias("sl"), F.col("lon").alias("so"))
    want = {(r[0], r[1]) for r in cities.crossJoin(s).where(haversine_km(F.col("lat"), F.col("lng"), F.col("sl"), F.col("so")) < radius).select("city_id", "station_id").collect()}
    assert got == want and len(want) > 100


def test_snap_and_rounding_keep_large_values(spark):
    df = spark.createDataFrame([(1e10,), (2e10,), (1e17,), (12.3456789,), (-0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(snap(F.col("x"))).collect()] == [1e10, 2e10, 1e17, 12.3456789, -0.5, None]
    assert [r[0] for r in finish(df).collect()] == [1e10, 2e10, 1e17, 12.3457, -0.5, None]


def test_stored_table_follows_its_inputs(spark, sf_small):
    d = tempfile.mkdtemp(prefix="airshed-stored-")
    for t in ("lineitem", "supplier", "nation"):
        spark.read.parquet(f"{sf_small}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    first = P.stored_merged(spark, d)
    n = first.count()
    assert P.stored_merged(spark, d).inputFiles() == first.inputFiles()
    half = spark.read.parquet(f"{sf_small}/lineitem.parquet").where("l_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(f"{d}/lineitem.parquet")
    again = P.stored_merged(spark, d)
    assert again.inputFiles() != first.inputFiles() and again.count() != n
    with pytest.raises(Exception, match="does not exist|FileNotFound|PATH_NOT_FOUND"):
        P.stored_merged(spark, "file:/no/such/store")
    assert os.path.exists(d)


def test_one_pass_over_the_feed(spark, sf_small):
    """Weights and coverage read the stored station-days: the raw feed isn't in their plan, and nothing is dealt round robin."""
    plan = P.CityPipeline(spark, sf_small).weather_city_days()._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "RoundRobin" not in plan
    plan = P.CityPipeline(spark, sf_small).merged()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
