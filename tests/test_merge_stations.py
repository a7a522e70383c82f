"""IDW merge, spatial range join vs brute force, splits."""

import datetime as dt
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from airshed.operators import eda as E
from airshed.operators import merge, split, stations
from airshed.functions.geo import haversine_km


def test_haversine_one_degree(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    v = df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert round(v, 4) == 111.1949


def _idw_rows(spark, t1, t2, d1=1.0, d2=3.0):
    day = dt.date(2024, 1, 1)
    sd = spark.createDataFrame([(1, day, t1, None, None, None), (2, day, t2, None, None, None)],
                               "station_id long, date date, temp_avg_c double, lat double, lon double, elev_m double")
    for c in ["temp_max_c", "temp_min_c", "dewpoint_c", "precip_mm", "wind_speed_kmh", "visibility_km",
              "station_pressure_hpa"]:
        sd = sd.withColumn(c, F.lit(None).cast("double"))
    cmap = spark.createDataFrame([(7, 1, d1, 1), (7, 2, d2, 2)], "city_id int, station_id long, distance_km double, rank int")
    return merge.idw_weather(sd, cmap).first()


def test_idw_two_stations(spark):
    r = _idw_rows(spark, 10.0, 20.0)
    assert round(r.temp_avg_c, 6) == 12.5
    assert r.station_count == 2 and r.temp_avg_c_source_count == 2
    assert r.data_source == "weighted_average"


def test_idw_null_skipped_and_zero_distance(spark):
    r = _idw_rows(spark, None, 20.0)
    assert r.temp_avg_c == 20.0 and r.temp_avg_c_source_count == 1 and r.station_count == 2
    r0 = _idw_rows(spark, 10.0, 20.0, d1=0.0, d2=1.0)   # weights 10 and 1
    assert round(r0.temp_avg_c, 6) == round((10 * 10 + 20 * 1) / 11, 6)


def test_idw_within_min_max(spark):
    rnd = random.Random(7)
    for _ in range(3):
        a, b = rnd.uniform(-20, 40), rnd.uniform(-20, 40)
        r = _idw_rows(spark, a, b, rnd.uniform(0, 50), rnd.uniform(0, 50))
        assert min(a, b) - 1e-9 <= r.temp_avg_c <= max(a, b) + 1e-9


def _brute(cities, stns, radius, n):
    out = {}
    for cid, la, lo in cities:
        cand = []
        for sid, sla, slo in stns:
            p1, p2 = math.radians(la), math.radians(sla)
            a = math.sin(math.radians(sla - la) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
                math.radians(slo - lo) / 2) ** 2
            dkm = 6371.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))
            if dkm < radius:
                cand.append((dkm, sid))
        out[cid] = [s for _, s in sorted(cand)[:n]]
    return out


def test_grid_range_join_matches_brute_force(spark):
    rnd = random.Random(11)
    cities = [(0, 0.0, 179.9), (1, 0.0, -179.95), (2, 89.7, 10.0), (3, -89.9, -100.0), (4, 45.0, 7.0),
              (5, 60.0, 0.01)]
    stns = []
    sid = 0
    for _, la, lo in cities:
        for _ in range(40):
            sla = max(-90.0, min(90.0, la + rnd.uniform(-1.5, 1.5)))
            slo = lo + rnd.uniform(-3, 3)
            slo = (slo + 180) % 360 - 180
            stns.append((sid, sla, slo))
            sid += 1
    cdf = spark.createDataFrame(cities, "city_id int, lat double, lng double")
    sdf = spark.createDataFrame(stns, "station_id long, lat double, lon double")
    for radius, n in [(50.0, 5), (120.0, 100)]:
        got = stations.nearest_stations(cdf, sdf, radius, n).orderBy("city_id", "rank").collect()
        g = {}
        for r in got:
            g.setdefault(r.city_id, []).append(r.station_id)
        exp = {k: v for k, v in _brute(cities, stns, radius, n).items() if v}
        assert g == exp


def test_chrono_split_positions(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [(f"C{i % 3}", d0 + dt.timedelta(days=i // 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "city_name string, date date")
    out = split.chrono_split(df).collect()
    roles = {}
    for r in out:
        roles[r.split] = roles.get(r.split, 0) + 1
    assert roles == {"train": 70, "val": 15, "test": 15}
    # chronological: every train date <= every val date <= every test date
    mx = {k: max(r.date for r in out if r.split == k) for k in roles}
    mn = {k: min(r.date for r in out if r.split == k) for k in roles}
    assert mx["train"] <= mn["val"] and mx["val"] <= mn["test"]


def test_skewness_bias_corrected(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 4.0, 9.0, 20.0]], "x double")
    v = df.agg(E.skewness_unbiased(F.col("x"))).first()[0]
    assert round(v, 6) == 1.49012


def test_distributed_rank_with_ties(spark):
    vals = [5.0, 1.0, 5.0, 3.0, 5.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vals)], "g int, i int, v double")
    got = {r.i: r.rk for r in E.grouped_avg_rank(df, "g", "v", "rk", n_buckets=3).collect()}
    import pandas as pd
    exp = pd.Series(vals).rank(method="average").tolist()
    assert [got[i] for i in range(len(vals))] == exp


def test_only_measurements_of_locations_that_serve_a_city_are_parsed(spark, sf_small, tmp_path):
    from airshed.operators import clean, merge
    from airshed.plans.pipeline import CityPipeline
    from airshed.sources import domain

    for t in ("nation", "supplier", "lineitem"):
        spark.read.parquet(f"{sf_small}/{t}.parquet").createOrReplaceTempView(f"own_{t}")
    spark.table("own_nation").write.parquet(f"{tmp_path}/nation.parquet")
    # forty times the suppliers: more than serve their cities, with a feed of their own each
    for t, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        spark.table(f"own_{t}").join(spark.range(40).select(F.col("id").alias("_i"))).withColumn(key, F.col(key) + F.col("_i") * 1000) \
            .drop("_i").write.parquet(f"{tmp_path}/{t}.parquet")
    p = CityPipeline(spark, str(tmp_path))
    mapped = {r[0] for r in p.air_map().select("station_id").collect()}
    served = {r[0] for r in p.air_served().select("location_id").distinct().collect()}
    every = domain.openaq_raw(spark, str(tmp_path)).select("location_id").distinct().count()
    assert served == mapped and len(served) < every
    want = merge.idw_air(merge.air_location_days(clean.outlier_air(clean.parse_air(domain.openaq_raw(spark, str(tmp_path))))), p.air_map())
    key = ["city_id", "date"]
    a, b = (d.select(*key, "pm25", "co", "station_count").toPandas().sort_values(key).reset_index(drop=True) for d in (p.air_city_days(), want))
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
