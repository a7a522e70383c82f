"""Distance to coast segments against plain spherical geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from airshed.operators import coast

CITY = "city_id long, lat double, lng double"
ARC = "lat1 double, lon1 double, lat2 double, lon2 double"


def _vec(lat, lon):
    la, lo = math.radians(lat), math.radians(lon)
    return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)


def _km(p, q):
    return 2 * 6371.0 * math.asin(min(1.0, math.dist(p, q) / 2))


def _sampled(city, arc, n=300):
    """The least distance to points strewn along the arc (no vector products)."""
    p, a, b = _vec(*city), _vec(*arc[:2]), _vec(*arc[2:])
    w = _km(a, b) / 6371.0
    if w == 0:
        return _km(p, a)

    def at(t):
        return tuple((math.sin((1 - t) * w) * x + math.sin(t * w) * y) / math.sin(w) for x, y in zip(a, b))

    k = min(range(n + 1), key=lambda k: _km(p, at(k / n)))
    lo, hi = max(0.0, (k - 1) / n), min(1.0, (k + 1) / n)
    for _ in range(80):  # the distance is convex around the best sample
        t1, t2 = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, t2) if _km(p, at(t1)) < _km(p, at(t2)) else (t1, hi)
    return _km(p, at((lo + hi) / 2))


def test_distance_matches_brute_force(spark):
    rnd = random.Random(3)
    places = [(0.0, 179.9), (0.3, -179.8), (89.3, 20.0), (-89.6, 100.0), (45.0, 7.0), (59.0, 0.0), (-33.0, 151.0)]
    arcs, cities = [], []
    for la, lo in places:
        for _ in range(4):
            a = (max(-90.0, min(90.0, la + rnd.uniform(-1, 1))), lo + rnd.uniform(-2, 2))
            b = (max(-90.0, min(90.0, a[0] + rnd.uniform(-6, 6))), a[1] + rnd.uniform(-8, 8))
            arcs.append((*a, *b))
        for _ in range(8):
            cities.append((max(-90.0, min(90.0, la + rnd.uniform(-2, 2))), lo + rnd.uniform(-3, 3)))
    wrap = lambda x: (x + 180) % 360 - 180
    arcs = [(a, wrap(b), c, wrap(d)) for a, b, c, d in arcs] + [(45.0, 7.0, 45.0, 7.0), (45.0, 7.0, 45.0, 7.0)]
    cities = [(k, la, wrap(lo)) for k, (la, lo) in enumerate(cities)]
    least = {k: min(_sampled((la, lo), arc) for arc in arcs) for k, la, lo in cities}
    for limit in (30.0, 100.0):
        got = {r.city_id: r.coast_km for r in coast.coast_distance(
            spark.createDataFrame(cities, CITY), spark.createDataFrame(arcs, ARC), "city_id", limit).collect()}
        want = {k: v for k, v in least.items() if v < limit}
        assert len(want) > 5 and got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-4)


def test_flags_and_odd_rows(spark):
    north = 1 / coast.KM_PER_DEGREE
    cities = spark.createDataFrame(
        [(1, 10.0 + 20 * north, 0.5, "near"), (2, 10.0 + 70 * north, 0.5, "between"), (3, 20.0, 0.5, "far"), (4, None, 0.5, "no place"),
         (5, 10.0, 0.0, "on an end"), (1, 10.0 + 20 * north, 0.5, "near again")], "city_id long, lat double, lng double, p string")
    arcs = spark.createDataFrame([(10.0, 0.0, 10.0, 1.0), (None, 0.0, 10.0, 1.0), (20.0, 0.0, None, 1.0)], ARC)
    got = {r.p: r for r in coast.coast_flags(cities, arcs, "city_id").collect()}
    assert {k: (r.is_coastal, r.is_inland) for k, r in got.items()} == {
        "near": (1, 0), "between": (0, 0), "far": (0, 1), "no place": (None, None), "on an end": (1, 0), "near again": (1, 0)}
    assert got["near"].coast_km == pytest.approx(20, abs=0.1) and got["on an end"].coast_km == pytest.approx(0, abs=1e-6)
    assert got["far"].coast_km is None and got["no place"].coast_km is None
    none = coast.coast_flags(cities, arcs.where(F.lit(False)), "city_id")
    assert {(r.coast_km, r.is_coastal, r.is_inland) for r in none.collect()} == {(None, 0, 1), (None, None, None)}
    assert coast.coast_flags(cities.where(F.lit(False)), arcs, "city_id").count() == 0
    with pytest.raises(ValueError):
        coast.coast_flags(cities, arcs, "city_id", 100.0, 50.0)


def test_long_arcs_are_cut_into_few_pieces(spark):
    arcs = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0)], ARC)
    assert coast.arc_pieces(arcs, 100.0).count() == math.ceil(math.pi / 2 * 6371 / 100)
