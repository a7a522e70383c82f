"""Domain views over the driver tables.

No air-quality files ship with the test data, so the raw feeds are derived,
deterministically and with plain column arithmetic, from the TPC-H-style
tables (see README "Test-data mapping"):

* ``cities``      <- nation       (25 rows; coordinates from the key)
* ``stations``    <- supplier     (weather station == air-quality location)
* ``coast_segments`` <- supplier  (one arc of the coast per supplier)
* ``gsod_raw``    <- lineitem     (one raw GSOD observation per line item)
* ``openaq_raw``  <- lineitem     (one raw hourly measurement per line item)
* ``hourly``      <- events       (hourly PM2.5 feed, 30 days)
* ``experiment_results`` <- orders x customer (a leaderboard-shaped table)

Every view is a lazy projection of a Parquet scan, so column pruning and
filter pushdown reach the files.  The same formulas are spelled in DuckDB SQL
in ``airshed.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD_START = "1998-01-01"
FOLD_EPOCH = "1995-01-01"
FOLD_DAYS = 730


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded_day(ts: Column) -> Column:
    """Fold a ship date onto two calendar years (1998-01-01 .. 1999-12-31)."""
    days = F.datediff(F.to_date(ts), F.lit(FOLD_EPOCH).cast("date")) % FOLD_DAYS
    return F.date_add(F.lit(FOLD_START).cast("date"), days.cast("int"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("int").alias("city_id"),
        F.col("n_name").alias("city_name"),
        (F.lit(-60.0) + (k * 37) % 121).cast("double").alias("lat"),
        (F.lit(-170.0) + (k * 73) % 341).cast("double").alias("lng"),
        F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("iso2"),
        (((k * 7919) % 997 + 1) * 1000).cast("long").alias("population"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather-station catalogue (USAF/WBAN, coordinates, END yyyymmdd)."""
    s = table(spark, sf_dir, "supplier")
    c = cities(spark, sf_dir)
    key = F.col("s_suppkey")
    return (
        s.join(c, s.s_nationkey == c.city_id)
        .select(
            key.alias("station_id"),
            key.cast("string").alias("usaf"),
            F.lit("99999").alias("wban"),
            F.col("city_id").alias("home_city_id"),
            (F.col("lat") + ((key * 13) % 101 - 50) / F.lit(100.0)).alias("lat"),
            (F.col("lng") + ((key * 17) % 101 - 50) / F.lit(100.0)).alias("lon"),
            (F.col("s_acctbal") / F.lit(10.0)).alias("elev_m"),
            (F.lit(20250101) - (key % 7) * 10000).cast("int").alias("end_ymd"),
        )
    )


def coast_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coastline arcs some 10 to 170 km north of the suppliers' cities, half a degree to 3.5 degrees long."""
    s = table(spark, sf_dir, "supplier")
    c = cities(spark, sf_dir)
    key = F.col("s_suppkey")
    lat1 = F.col("lat") + ((F.col("city_id") * 7) % 5) * 0.3 + 0.1 + ((key * 13) % 21) / F.lit(100.0)
    lon1 = F.col("lng") + ((key * 29) % 301 - 150) / F.lit(100.0)
    return s.join(c, s.s_nationkey == c.city_id).select(
        key.alias("segment_id"), lat1.alias("lat1"), lon1.alias("lon1"),
        (lat1 + ((key * 31) % 41 - 20) / F.lit(100.0)).alias("lat2"),
        (lon1 + 0.5 + ((key * 11) % 301) / F.lit(100.0)).alias("lon2"))


def gsod_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily station weather, imperial units, with GSOD sentinels."""
    li = table(spark, sf_dir, "lineitem")
    temp = F.lit(20.0) + F.col("l_quantity")
    sentinel = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)
    return li.select(
        F.col("l_suppkey").alias("STATION"),
        folded_day(F.col("l_shipdate")).alias("DATE"),
        F.when(sentinel, F.lit(9999.9)).otherwise(temp).alias("TEMP"),
        (temp + F.lit(100.0) * F.col("l_tax")).alias("MAX"),
        (temp - F.lit(100.0) * F.col("l_discount")).alias("MIN"),
        F.when(sentinel, F.lit(9999.9)).otherwise(temp - F.col("l_linenumber")).alias("DEWP"),
        F.when(sentinel, F.lit(999.9)).otherwise(F.lit(0.5) + (F.col("l_partkey") % 130) / F.lit(2.0)).alias("VISIB"),
        F.when(sentinel, F.lit(999.9)).otherwise((F.col("l_orderkey") % 300) / F.lit(10.0)).alias("WDSP"),
        F.when(sentinel, F.lit(99.99)).otherwise(F.col("l_tax")).alias("PRCP"),
        F.when(F.col("l_linestatus") == "F", F.lit(9999.9))
        .otherwise(F.lit(1000.0) + F.col("l_orderkey") % 40).alias("SLP"),
        F.when(sentinel, F.lit(999.9)).otherwise(F.lit(990.0) + F.col("l_orderkey") % 50).alias("STP"),
        F.concat(F.lit("0"), (F.col("l_linenumber") % 2).cast("string"), F.lit("0000")).alias("FRSHTT"),
        (F.col("l_linenumber") + 2).cast("int").alias("TEMP_ATTRIBUTES"),
        F.col("l_orderkey").alias("ROW_KEY"),
        F.col("l_linenumber").alias("ROW_LINE"),
    )


PARAMETER_ORDER = ["pm25", "pm10", "o3", "no2", "so2", "co"]


def openaq_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hourly air-quality measurements in long form with mixed units/offsets."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") % 6                      # parameter index into PARAMETER_ORDER
    param = F.element_at(F.array(*[F.lit(p) for p in PARAMETER_ORDER]), (k + 1).cast("int"))
    alt_unit = (F.col("l_linenumber") % 2) == 1
    pm = k <= 1                                      # pm25, pm10
    spike = F.when(F.col("l_partkey") % 50 == 0, F.lit(10.0)).otherwise(F.lit(1.0))
    base = (
        F.when(pm, F.col("l_extendedprice") / F.lit(400.0))
        .when(k == 5, F.col("l_extendedprice") / F.lit(2500.0))
        .otherwise(F.col("l_extendedprice") / F.lit(250000.0))
        * spike
    )
    value = F.when(alt_unit & pm, base / F.lit(1000.0)).when(alt_unit, base * F.lit(1000.0)).otherwise(base)
    units = (
        F.when(pm & alt_unit, F.lit("mg/m³")).when(pm, F.lit("µg/m³"))
        .when(alt_unit, F.lit("ppb")).otherwise(F.lit("ppm"))
    )
    hour = ((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 24).cast("string")
    offset = F.element_at(F.array(F.lit("+00:00"), F.lit("+08:00"), F.lit("-05:00")),
                          (F.col("l_partkey") % 3 + 1).cast("int"))
    stamp = F.concat(folded_day(F.col("l_shipdate")).cast("string"), F.lit("T"),
                     F.lpad(hour, 2, "0"), F.lit(":00:00"), offset)
    return li.select(
        F.col("l_suppkey").alias("location_id"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit("n/a")).otherwise(stamp).alias("datetime"),
        param.alias("parameter"),
        units.alias("units"),
        value.alias("value"),
        F.col("l_orderkey").alias("row_key"),
        F.col("l_linenumber").alias("row_line"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly PM2.5 feed: location = user_id % 25, value = PM2.5 in µg/m³."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        (F.col("user_id") % 25).alias("location_id"),
        F.col("ts"),
        F.col("value").alias("pm25"),
        F.col("event_type"),
        F.col("props"),
    )


def experiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboard-shaped results: mode x algorithm x city with RMSE/MAE/R2 columns."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(
        F.col("c_mktsegment").alias("mode"),
        F.col("o_orderpriority").alias("algorithm"),
        F.col("c_nationkey").alias("city_id"),
    ).agg(
        (F.avg("o_totalprice") / F.lit(10000.0)).alias("val_rmse"),
        (F.avg("c_acctbal") / F.lit(1000.0)).alias("val_mae"),
        (F.lit(1.0) - F.avg("o_totalprice") / F.lit(1000000.0)).alias("val_r2"),
        (F.max("o_totalprice") / F.lit(50000.0)).alias("test_rmse"),
        (F.stddev_samp("o_totalprice") / F.lit(10000.0)).alias("test_mae"),
        (F.lit(1.0) - F.min("o_totalprice") / F.lit(100000.0)).alias("test_r2"),
        F.count("*").cast("long").alias("n_train"),
    )
