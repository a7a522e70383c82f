"""AQI column builders (JVM-side CASE expressions, no Python UDFs).

``aqi_strict`` reproduces the published calculator exactly: the first band
whose closed interval contains the value wins, interpolation is rounded
half-to-even, values above the table use the slope from the second-last band's
lower corner to the last band's upper corner (capped at 500), and values that
fall between two bands or below zero give 0.  ``aqi_epa`` first truncates the
concentration the way EPA reporting does, which removes the band gaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from airshed.functions.units import snap
from airshed.constants import (
    AQI_BREAKPOINTS,
    AQI_CAP,
    AQI_CATEGORIES,
    AQI_TRUNCATION_DIGITS,
    HEALTH_ADVICE,
    OZONE_1H_BREAKPOINTS,
    OUT_OF_RANGE_CATEGORY,
    PM25_BREAKPOINTS_2024,
    POLLUTANTS,
    SHORT_ADVICE,
    UNKNOWN_CATEGORY,
)


def _interp(c: Column, band) -> Column:
    c_low, c_high, i_low, i_high = band
    slope = (i_high - i_low) / (c_high - c_low)
    return F.lit(slope) * (c - F.lit(float(c_low))) + F.lit(float(i_low))


def aqi_strict(c: Column | str, pollutant: str, bands=None) -> Column:
    c = snap(F.col(c) if isinstance(c, str) else c)
    bands = bands or AQI_BREAKPOINTS.get(pollutant)
    if not bands:
        return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.lit(0))
    expr = F.when(c.isNull(), F.lit(None).cast("double"))
    for band in bands:
        expr = expr.when((c >= F.lit(float(band[0]))) & (c <= F.lit(float(band[1]))), F.rint(_interp(c, band)))
    last, prev = bands[-1], bands[-2] if len(bands) > 1 else (0.0, bands[-1][1], 0, bands[-1][3])
    extrap = (prev[0], last[1], prev[2], last[3])
    expr = expr.when(c > F.lit(float(last[1])), F.least(F.rint(_interp(c, extrap)), F.lit(float(AQI_CAP))))
    return expr.otherwise(F.lit(0.0)).cast("int")


def epa_truncate(c: Column | str, pollutant: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    k = AQI_TRUNCATION_DIGITS.get(pollutant, 3)
    scale = float(10 ** k)
    return F.floor(c * F.lit(scale) + F.lit(1e-9)) / F.lit(scale)


def aqi_epa(c: Column | str, pollutant: str) -> Column:
    return aqi_strict(epa_truncate(c, pollutant), pollutant)


def aqi_pm25_2024(c: Column | str) -> Column:
    """PM2.5 AQI by the bands in force since 2024, after truncation."""
    return aqi_strict(epa_truncate(c, "pm25"), "pm25", PM25_BREAKPOINTS_2024)


def aqi_ozone(max_8h: Column, max_1h: Column) -> Column:
    """Ozone AQI: the higher of the 8-hour value's and the 1-hour value's; the 1-hour scale has no
    bands below 0.125 ppm, where it is ignored."""
    hour = epa_truncate(max_1h, "o3")
    one = F.when(snap(hour) >= F.lit(OZONE_1H_BREAKPOINTS[0][0]), aqi_strict(hour, "o3", OZONE_1H_BREAKPOINTS))
    return F.greatest(aqi_epa(max_8h, "o3"), one)


def aqi_columns(df, pollutants=POLLUTANTS, suffix: str = "_aqi", strict: bool = True):
    fn = aqi_strict if strict else aqi_epa
    return df.select("*", *[fn(F.col(p), p).alias(f"{p}{suffix}") for p in pollutants if p in df.columns])


def overall_aqi(cols: list[str]) -> Column:
    """Max over pollutant AQIs; NULLs skipped, all NULL -> NULL."""
    return F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])


def primary_pollutant(aqi_cols: dict[str, str]) -> Column:
    """Arg-max pollutant, first in column order on ties; nothing -> NULL."""
    overall = overall_aqi(list(aqi_cols.values()))
    expr = None
    for pollutant, col in aqi_cols.items():
        cond = F.col(col) == overall
        expr = F.when(cond, F.lit(pollutant)) if expr is None else expr.when(cond, F.lit(pollutant))
    return expr


def category(aqi: Column | str, field: int = 2) -> Column:
    """Category attribute by closed integer ranges; out of range -> Hazardous, NULL -> Unknown.

    field: 2 label, 3 color, 4 chinese, 5 description.
    """
    aqi = F.col(aqi) if isinstance(aqi, str) else aqi
    fallback = next(c for c in AQI_CATEGORIES if c[2] == OUT_OF_RANGE_CATEGORY)
    expr = F.when(aqi.isNull(), F.lit(UNKNOWN_CATEGORY if field == 2 else None))
    for cat in AQI_CATEGORIES:
        expr = expr.when((aqi >= cat[0]) & (aqi <= cat[1]), F.lit(cat[field]))
    return expr.otherwise(F.lit(fallback[field]))


def advice_field(label: Column, field: int) -> Column:
    """Advice record attribute for a category label (unknown -> Good).

    field: 1 message, 2 health_effects, 3 recommendation, 4 color, 5 icon.
    """
    good = HEALTH_ADVICE[0]
    expr = reduce(lambda e, a: e.when(label == a[0], F.lit(a[field])), HEALTH_ADVICE[1:],
                  F.when(label == good[0], F.lit(good[field])))
    return expr.otherwise(F.lit(good[field]))


def short_advice(aqi: Column) -> Column:
    label = category(aqi)
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for lab, text in SHORT_ADVICE:
        expr = expr.when(label == lab, F.lit(text))
    return expr.otherwise(F.lit("未知"))


def breakpoint_rows():
    """Rows of the breakpoint dimension: (pollutant, band, c_low, c_high, i_low, i_high)."""
    return [(p, i + 1, float(b[0]), float(b[1]), int(b[2]), int(b[3]))
            for p in POLLUTANTS for i, b in enumerate(AQI_BREAKPOINTS[p])]
