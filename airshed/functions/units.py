"""Unit conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airshed.constants import F_TO_C_OFFSET, INCH_TO_MM, KNOT_TO_KMH, MILE_TO_KM, POLLUTANT_UNITS, UNIT_FACTORS


def f_to_c(c: Column) -> Column:
    return (c - F.lit(F_TO_C_OFFSET)) * F.lit(5.0) / F.lit(9.0)


def inch_to_mm(c: Column) -> Column:
    return c * F.lit(INCH_TO_MM)


def knot_to_kmh(c: Column) -> Column:
    return c * F.lit(KNOT_TO_KMH)


def mile_to_km(c: Column) -> Column:
    return c * F.lit(MILE_TO_KM)


def target_unit(parameter: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for p, u in POLLUTANT_UNITS.items():
        expr = expr.when(parameter == p, F.lit(u))
    return expr.otherwise(F.lit("µg/m³"))


def convert_to_target(value: Column, unit: Column, parameter: Column) -> Column:
    """value in ``unit`` -> value in the pollutant's target unit.

    Same unit, unknown unit or NULL unit -> unchanged.
    """
    to = target_unit(parameter)
    expr = F.when(unit.isNull() | (unit == to), value)
    for frm, dst, factor in UNIT_FACTORS:
        if factor >= 1:
            expr = expr.when((unit == frm) & (to == dst), value * F.lit(factor))
        else:
            expr = expr.when((unit == frm) & (to == dst), value / F.lit(round(1 / factor)))
    return expr.otherwise(value)


def snap(c: Column) -> Column:
    """Value snapped to 1e-9 before a threshold comparison, so a band or category never
    depends on the last bits of a sum (which vary with partitioning / summation order)."""
    return F.rint(c * F.lit(1e9)) / F.lit(1e9)
