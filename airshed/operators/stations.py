"""Station / city spatial operators.

``nearest_stations`` is a range join (distance < radius) followed by a
per-city top-n.  Instead of a cross product it buckets both sides onto a
lat/lon grid whose cell edge equals the radius: each city is exploded onto the
cells its search circle can touch, stations carry their single cell, and the
two sides meet in an equi-join on the cell id.  Exact haversine filtering and
``row_number() <= n`` (which Spark turns into a pre-shuffle group limit)
finish the job.  Neither side is collected to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airshed.functions.geo import cell_size_deg, haversine_km


def _lon_cells(d: float) -> int:
    """Whole cells around the circle; each is 360 / n degrees wide (at least ``d``), so they tile it
    exactly and stepping across the date line stays in step."""
    return max(1, int(math.floor(360.0 / d)))


def station_cells(stations: DataFrame, d: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    n_lon = _lon_cells(d)
    return stations.select(
        "*",
        F.floor(F.col(lat) / F.lit(d)).cast("long").alias("cell_lat"),
        F.pmod(F.floor((F.col(lon) + F.lit(180.0)) / F.lit(360.0 / n_lon)), F.lit(n_lon)).cast("long").alias("cell_lon"),
    )


def search_cells(points: DataFrame, radius_km: float, d: float, lat: str = "lat", lon: str = "lng") -> DataFrame:
    """Explode each search point onto every grid cell its circle may touch."""
    n_lon = _lon_cells(d)
    la, lo = F.col(lat), F.col(lon)
    lat_lo = F.floor((la - F.lit(d)) / F.lit(d)).cast("long")
    lat_hi = F.floor((la + F.lit(d)) / F.lit(d)).cast("long")
    edge = F.least(F.abs(la) + F.lit(d), F.lit(89.0))
    half_w = F.lit(d * 1.01) / F.cos(F.radians(edge))
    near_pole = (F.abs(la) + F.lit(d)) >= F.lit(89.0)
    width = F.lit(360.0 / n_lon)
    lon_lo = F.floor((lo + F.lit(180.0) - half_w) / width).cast("long")
    lon_hi = F.floor((lo + F.lit(180.0) + half_w) / width).cast("long")
    wide = near_pole | ((lon_hi - lon_lo + 1) >= F.lit(n_lon))
    lon_seq = F.when(wide, F.sequence(F.lit(0).cast("long"), F.lit(n_lon - 1).cast("long"))) \
        .otherwise(F.sequence(lon_lo, lon_hi))
    wrapped = F.array_distinct(F.transform(lon_seq, lambda x: F.pmod(x, F.lit(n_lon)).cast("long")))
    return (
        points.select("*", F.explode(F.sequence(lat_lo, lat_hi)).alias("cell_lat"), wrapped.alias("_lons"))
        .select(*points.columns, "cell_lat", F.explode("_lons").alias("cell_lon"))
    )


def within_radius(cities: DataFrame, stations: DataFrame, radius_km: float,
                  city_key: str = "city_id") -> DataFrame:
    """All (city, station, distance_km) with haversine distance < radius (strict)."""
    d = cell_size_deg(radius_km)
    c = search_cells(cities.select(city_key, F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng")),
                     radius_km, d, lat="c_lat", lon="c_lng")
    s = station_cells(stations.select("station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")),
                      d, lat="s_lat", lon="s_lon")
    dist = haversine_km(F.col("c_lat"), F.col("c_lng"), F.col("s_lat"), F.col("s_lon"))
    return (
        c.join(s, ["cell_lat", "cell_lon"])
        .select(city_key, "station_id", dist.alias("distance_km"))
        .where(F.col("distance_km") < F.lit(float(radius_km)))
    )


def nearest_stations(cities: DataFrame, stations: DataFrame, radius_km: float, n: int,
                     city_key: str = "city_id") -> DataFrame:
    """n closest stations per city within the radius; ties by station id."""
    w = Window.partitionBy(city_key).orderBy(F.col("distance_km"), F.col("station_id"))
    return (
        within_radius(cities, stations, radius_km, city_key)
        .select("*", F.row_number().over(w).alias("rank"))
        .where(F.col("rank") <= n)
    )


def active_stations(stations: DataFrame, year: int) -> DataFrame:
    """Locatable and active: coordinates present and END >= (year - 2) * 10000."""
    return stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                          & (F.col("end_ymd") >= F.lit((year - 2) * 10000)))


def station_key(usaf: Column, wban: Column) -> Column:
    return F.concat_ws("-", F.lpad(usaf, 6, "0"), F.lpad(wban, 5, "0"))


def in_bbox(df: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float,
            lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).between(F.lit(min_lat), F.lit(max_lat))
                    & F.col(lon).between(F.lit(min_lon), F.lit(max_lon)))


def city_lookup(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Normalised (name, country) lookup; among duplicates the largest population wins (then id).

    The winner is resolved once per catalogue key (one aggregate), so every query row meets at
    most one catalogue row -- no fan-out even when one name has very many entries."""
    cat = catalogue.select(F.lower(F.trim(F.col("city_ascii"))).alias("_qn"), F.upper(F.col("iso2")).alias("_qc"),
                           F.col("id"), F.col("lat"), F.col("lng"), F.col("population"))
    best = cat.groupBy("_qn", "_qc").agg(F.max_by(
        F.struct(F.col("id").alias("match_id"), F.col("lat").alias("match_lat"), F.col("lng").alias("match_lng"),
                 F.col("population").alias("match_population")),
        F.struct(F.col("population"), -F.col("id"))).alias("m"))
    q = queries.select("*", F.lower(F.trim(F.col("query_name"))).alias("_qn"),
                       F.upper(F.trim(F.col("query_iso2"))).alias("_qc"))
    return q.join(best, ["_qn", "_qc"]).select(*queries.columns, "m.*")


def city_search(catalogue: DataFrame, pattern: str, limit: int) -> DataFrame:
    """City or country matches a case-insensitive pattern; first ``limit`` by id (a top-k feature)."""
    p = pattern.lower()
    return (catalogue.where(F.lower(F.col("city_ascii")).rlike(p) | F.lower(F.col("country")).rlike(p))
            .orderBy("id").limit(limit))
