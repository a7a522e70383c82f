"""Property tests: gap fill on random sparse series equals a brute-force statement of the rules."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from airshed.operators import timeseries as ts

series = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=14)
gaps = st.lists(st.integers(1, 3), min_size=14, max_size=14)


def _frame(spark, values, steps):
    d, rows = dt.date(2024, 1, 1), []
    for v, s in zip(values, steps):
        rows.append(("A", d, v))
        d += dt.timedelta(days=s)
    return spark.createDataFrame(rows, "city_name string, date date, x double"), [r[1] for r in rows]


def _expected_time(values, dates, limit=3):
    out = []
    for i, v in enumerate(values):
        if v is not None:
            out.append(v)
            continue
        p = next((j for j in range(i - 1, -1, -1) if values[j] is not None), None)
        n = next((j for j in range(i + 1, len(values)) if values[j] is not None), None)
        if p is None or i - p > limit:
            out.append(None)
        elif n is None:
            out.append(values[p])
        else:
            span = (dates[n] - dates[p]).days
            out.append(values[p] + (values[n] - values[p]) * (dates[i] - dates[p]).days / span)
    return out


def _expected_linear(values):
    out = []
    for i, v in enumerate(values):
        if v is not None:
            out.append(v)
            continue
        p = next((j for j in range(i - 1, -1, -1) if values[j] is not None), None)
        n = next((j for j in range(i + 1, len(values)) if values[j] is not None), None)
        if p is not None and n is not None:
            out.append(values[p] + (values[n] - values[p]) * (i - p) / (n - p))
        else:
            out.append(values[p] if p is not None else (values[n] if n is not None else None))
    return out


def _close(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and abs(x - y) < 1e-9)
               for x, y in zip(a, b)) and len(a) == len(b)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=series, steps=gaps)
def test_time_interpolation_matches_rules(spark, values, steps):
    df, dates = _frame(spark, values, steps)
    got = [r.x for r in ts.interpolate_time_limit(df, ["x"]).orderBy("date").collect()]
    assert _close(got, _expected_time(values, dates))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=series, steps=gaps)
def test_linear_interpolation_matches_rules(spark, values, steps):
    df, _ = _frame(spark, values, steps)
    got = [r.x for r in ts.interpolate_linear(df, ["x"]).orderBy("date").collect()]
    assert _close(got, _expected_linear(values))


stations = st.lists(st.tuples(st.one_of(st.none(), st.floats(-20, 40, allow_nan=False)),
                              st.one_of(st.none(), st.floats(0, 60, allow_nan=False))), min_size=1, max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(obs=stations)
def test_idw_matches_weighted_mean(spark, obs):
    from pyspark.sql import functions as F

    from airshed.constants import WEATHER_COLS
    from airshed.operators import merge
    day = dt.date(2024, 1, 1)
    rows = [(i, day, v, 1.0, 1.0, 0.0) for i, (v, _) in enumerate(obs)]
    sd = spark.createDataFrame(rows, "station_id long, date date, temp_avg_c double, lat double, lon double, "
                                     "elev_m double")
    for c in WEATHER_COLS[1:]:
        sd = sd.withColumn(c, F.lit(None).cast("double"))
    cmap = spark.createDataFrame([(1, i, d, i + 1) for i, (_, d) in enumerate(obs)],
                                 "city_id int, station_id long, distance_km double, rank int")
    r = merge.idw_weather(sd, cmap).first()
    present = [(v, 1.0 / max(1.0 if d is None else d, 0.1)) for v, d in obs if v is not None]
    exp = sum(v * w for v, w in present) / sum(w for _, w in present) if present else None
    if exp is None:
        assert r.temp_avg_c is None
    else:
        assert abs(r.temp_avg_c - exp) < 1e-9 * max(1.0, abs(exp))
    assert r.station_count == len(obs)
    assert r.data_source == ("single_station" if len(obs) == 1 else "weighted_average")
    assert r.temp_avg_c_source_count == (1 if len(obs) == 1 else len(present))
