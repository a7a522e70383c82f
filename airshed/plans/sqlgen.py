"""DuckDB SQL fragments generated from the fixed tables (oracle side only)."""

from __future__ import annotations

from airshed.constants import (AQI_BREAKPOINTS, AQI_CAP, AQI_CATEGORIES, AQI_TRUNCATION_DIGITS, HEALTH_ADVICE,
                               SHORT_ADVICE)


def dlit(x: float) -> str:
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def slit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def snap_sql(v: str) -> str:
    return f"(floor(({v}) * 1e9 + 0.5e0) / 1e9)"


def aqi_sql(v: str, pollutant: str, bands=None) -> str:
    v = snap_sql(v)
    bands = bands or AQI_BREAKPOINTS.get(pollutant)
    if not bands:
        return f"CASE WHEN {v} IS NULL THEN NULL ELSE 0 END"

    def interp(b):
        slope = (b[3] - b[2]) / (b[1] - b[0])
        return f"{dlit(slope)} * ({v} - {dlit(b[0])}) + {dlit(b[2])}"

    parts = [f"WHEN {v} IS NULL THEN NULL"]
    for b in bands:
        parts.append(f"WHEN {v} >= {dlit(b[0])} AND {v} <= {dlit(b[1])} THEN round_even({interp(b)}, 0)")
    last, prev = bands[-1], bands[-2]
    ext = (prev[0], last[1], prev[2], last[3])
    parts.append(f"WHEN {v} > {dlit(last[1])} THEN least(round_even({interp(ext)}, 0), {dlit(AQI_CAP)})")
    return "CAST(CASE " + " ".join(parts) + " ELSE 0e0 END AS INTEGER)"


def epa_trunc_sql(v: str, pollutant: str) -> str:
    k = AQI_TRUNCATION_DIGITS.get(pollutant, 3)
    s = dlit(10 ** k)
    return f"(floor({v} * {s} + 1e-09) / {s})"


def aqi_by_parameter_sql(v: str, param: str, epa: bool = False) -> str:
    parts = []
    for p in AQI_BREAKPOINTS:
        x = epa_trunc_sql(v, p) if epa else v
        parts.append(f"WHEN {param} = '{p}' THEN {aqi_sql(x, p)}")
    return f"(CASE {' '.join(parts)} ELSE CASE WHEN {v} IS NULL THEN NULL ELSE 0 END END)"


def category_sql(a: str, field: int = 2) -> str:
    fallback = next(c for c in AQI_CATEGORIES if c[2] == "Hazardous")
    null = "'Unknown'" if field == 2 else "NULL"
    parts = [f"WHEN {a} IS NULL THEN {null}"]
    for c in AQI_CATEGORIES:
        parts.append(f"WHEN {a} >= {c[0]} AND {a} <= {c[1]} THEN {slit(c[field])}")
    return f"(CASE {' '.join(parts)} ELSE {slit(fallback[field])} END)"


def advice_sql(label: str, field: int) -> str:
    parts = [f"WHEN {label} = {slit(a[0])} THEN {slit(a[field])}" for a in HEALTH_ADVICE]
    return f"(CASE {' '.join(parts)} ELSE {slit(HEALTH_ADVICE[0][field])} END)"


def greatest_sql(cols: list[str]) -> str:
    return f"greatest({', '.join(cols)})"


def primary_sql(aqi_cols: dict[str, str]) -> str:
    g = greatest_sql(list(aqi_cols.values()))
    parts = [f"WHEN {c} = {g} THEN '{p}'" for p, c in aqi_cols.items()]
    return f"(CASE {' '.join(parts)} END)"


def short_advice_sql(label: str) -> str:
    parts = [f"WHEN {label} = {slit(a)} THEN {slit(t)}" for a, t in SHORT_ADVICE]
    return f"(CASE {' '.join(parts)} ELSE '未知' END)"
