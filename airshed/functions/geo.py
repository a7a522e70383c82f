"""Great-circle distance and spatial grid cells (native column math)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from airshed.constants import EARTH_RADIUS_KM

KM_PER_DEGREE = 2 * math.pi * EARTH_RADIUS_KM / 360.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km with R = 6371."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    c = F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
    return F.lit(EARTH_RADIUS_KM) * c


def cell_size_deg(radius_km: float) -> float:
    """Grid cell edge (degrees) so that a radius never spans more than one cell in latitude."""
    return max(radius_km / KM_PER_DEGREE, 1e-6)
