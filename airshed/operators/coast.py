"""Distance to a coastline that is given as a table of segments.

The coast is data: rows (lat1, lon1, lat2, lon2), each the shorter great-circle arc between its
ends.  Arcs are cut into pieces no longer than the distance limit; a piece carries the one grid
cell of its middle, and each point searches the cells within limit + half a piece, so the two
sides meet in an equi-join as stations and cities do.  Of all pieces met, only the least
distance of a point is kept, by a partial aggregate before the shuffle.

All geometry is done on unit vectors, computed once a row on either side, so the date line and
the poles need no special case and a pair costs a few products.

Cases: a segment with a null coordinate is left out; a point with one has null results.  A
segment of two equal ends is a point.  Without segments within the limit the distance is null.
Points whose keys repeat get the same distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airshed.constants import EARTH_RADIUS_KM
from airshed.functions.geo import KM_PER_DEGREE
from airshed.functions.units import snap
from airshed.operators.stations import search_cells, station_cells

COASTAL_KM, INLAND_KM = 50.0, 100.0


def unit_vector(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.array(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _angle(a: Column, b: Column) -> Column:
    """Radians between two unit vectors, from the chord (exact for small angles too)."""
    d = [a[i] - b[i] for i in range(3)]
    return F.lit(2.0) * F.asin(F.least(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 2, F.lit(1.0)))


def _along(a: Column, b: Column, angle: Column, t: Column) -> Column:
    """The unit vector at share ``t`` of the arc from ``a`` to ``b``."""
    wa, wb = F.sin((F.lit(1.0) - t) * angle) / F.sin(angle), F.sin(t * angle) / F.sin(angle)
    return F.when(F.sin(angle) == 0, a).otherwise(F.array(*[wa * a[i] + wb * b[i] for i in range(3)]))


def arc_pieces(segments: DataFrame, longest_km: float) -> DataFrame:
    """(a, b, normal, lat, lon): pieces of at most ``longest_km`` with the place of their middle.

    The unit normal is that of the whole segment (null for a point), so cutting moves no piece off its arc."""
    ends = ["lat1", "lon1", "lat2", "lon2"]
    s = segments.where(F.greatest(*[F.isnull(c).cast("int") for c in ends]) == 0)
    s = s.select(unit_vector(F.col("lat1"), F.col("lon1")).alias("a"), unit_vector(F.col("lat2"), F.col("lon2")).alias("b"))
    s = s.select("a", "b", _angle(F.col("a"), F.col("b")).alias("angle"), _cross(F.col("a"), F.col("b")).alias("n"))
    size = F.sqrt(_dot(F.col("n"), F.col("n")))
    normal = F.when(size > 0, F.transform("n", lambda x: x / size))
    pieces = F.greatest(F.ceil(F.col("angle") * EARTH_RADIUS_KM / longest_km), F.lit(1)).cast("int")
    s = s.select("a", "b", "angle", normal.alias("normal"), pieces.alias("m"))
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    a, b, angle = F.col("a"), F.col("b"), F.col("angle")
    s = s.select(
        _along(a, b, angle, F.col("k") / F.col("m")).alias("a"), _along(a, b, angle, (F.col("k") + 1) / F.col("m")).alias("b"),
        "normal", _along(a, b, angle, (F.col("k") + 0.5) / F.col("m")).alias("mid"))
    mid = F.col("mid")
    return s.select("a", "b", "normal", F.degrees(F.asin(F.greatest(F.least(mid[2], F.lit(1.0)), F.lit(-1.0)))).alias("lat"),
                    F.degrees(F.atan2(mid[1], mid[0])).alias("lon"))


def arc_distance_km(p: Column, a: Column, b: Column, normal: Column) -> Column:
    """Great-circle distance from the point to the arc: to its circle where the foot lies on the arc, else to the nearer end."""
    beside = (_dot(p, _cross(normal, a)) >= 0) & (_dot(p, _cross(normal, b)) <= 0)
    to_circle = F.asin(F.least(F.abs(_dot(p, normal)), F.lit(1.0)))
    return EARTH_RADIUS_KM * F.when(beside, to_circle).otherwise(F.least(_angle(p, a), _angle(p, b)))


def coast_distance(points: DataFrame, segments: DataFrame, key: str, limit_km: float = INLAND_KM,
                   lat: str = "lat", lon: str = "lng") -> DataFrame:
    """(key, coast_km) of the points with a segment nearer than ``limit_km``."""
    reach = 1.5 * limit_km * 1.0001
    d = max(reach / KM_PER_DEGREE, 1e-6)
    at = points.select(F.col(key).alias("_key"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    at = at.where(F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).distinct()
    at = at.select("*", unit_vector(F.col("_lat"), F.col("_lon")).alias("p"))
    met = search_cells(at, reach, d, "_lat", "_lon").join(station_cells(arc_pieces(segments, limit_km), d), ["cell_lat", "cell_lon"])
    far = met.select("_key", arc_distance_km(F.col("p"), F.col("a"), F.col("b"), F.col("normal")).alias("km"))
    near = far.groupBy("_key").agg(F.min("km").alias("coast_km"))
    return near.where(snap(F.col("coast_km")) < limit_km).withColumnRenamed("_key", key)


def coast_flags(points: DataFrame, segments: DataFrame, key: str, coastal_km: float = COASTAL_KM,
                inland_km: float = INLAND_KM, lat: str = "lat", lon: str = "lng") -> DataFrame:
    """``points`` with coast_km (null from ``inland_km`` on), is_coastal (at most ``coastal_km``) and is_inland."""
    if not 0 <= coastal_km <= inland_km or not math.isfinite(inland_km):
        raise ValueError("0 <= coastal_km <= inland_km, finite")
    near = coast_distance(points, segments, key, inland_km, lat, lon)
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    coastal = F.coalesce(snap(F.col("coast_km")) <= coastal_km, F.lit(False))
    return points.join(near, key, "left").select(
        *points.columns, "coast_km", F.when(placed, coastal.cast("int")).alias("is_coastal"),
        F.when(placed, F.col("coast_km").isNull().cast("int")).alias("is_inland"))


def geo_interactions(days: DataFrame) -> DataFrame:
    """City-days with coast distance x wind, elevation x pressure and latitude x temperature."""
    return days.select(
        "*", (F.col("coast_km") * F.col("wind_speed_kmh")).alias("coast_wind"),
        (F.col("elev_m") * F.col("station_pressure_hpa")).alias("elevation_pressure"),
        (F.col("lat") * F.col("temp_avg_c")).alias("latitude_temperature"))
