"""DuckDB spelling of the domain views (``airshed.sources.domain``).

The oracle SQL of every registered query starts with ``with_views(...)`` so it
runs on the driver-registered raw tables.  Only the formulas are shared with
the Spark side; the SQL is written independently as the correctness check.
"""

from __future__ import annotations

VIEWS = {
    "city": """
  SELECT CAST(n_nationkey AS INTEGER) AS city_id, n_name AS city_name,
         CAST(-60e0 + (n_nationkey * 37) % 121 AS DOUBLE) AS lat,
         CAST(-170e0 + (n_nationkey * 73) % 341 AS DOUBLE) AS lng,
         'C' || CAST(n_regionkey AS VARCHAR) AS iso2,
         CAST(((n_nationkey * 7919) % 997 + 1) * 1000 AS BIGINT) AS population
  FROM nation""",
    "station": """
  SELECT s_suppkey AS station_id, CAST(s_suppkey AS VARCHAR) AS usaf, '99999' AS wban,
         c.city_id AS home_city_id,
         c.lat + ((s_suppkey * 13) % 101 - 50) / 100e0 AS lat,
         c.lng + ((s_suppkey * 17) % 101 - 50) / 100e0 AS lon,
         s_acctbal / 10e0 AS elev_m,
         CAST(20250101 - (s_suppkey % 7) * 10000 AS INTEGER) AS end_ymd
  FROM supplier s JOIN city c ON s.s_nationkey = c.city_id""",
    "coast_segment": """
  SELECT segment_id, lat1, lon1, lat1 + ((segment_id * 31) % 41 - 20) / 100e0 AS lat2,
         lon1 + 0.5e0 + ((segment_id * 11) % 301) / 100e0 AS lon2
  FROM (SELECT s_suppkey AS segment_id,
               c.lat + ((c.city_id * 7) % 5) * 0.3e0 + 0.1e0 + ((s_suppkey * 13) % 21) / 100e0 AS lat1,
               c.lng + ((s_suppkey * 29) % 301 - 150) / 100e0 AS lon1
        FROM supplier s JOIN city c ON s.s_nationkey = c.city_id) t""",
    "gsod_raw": """
  SELECT l_suppkey AS "STATION",
         date '1998-01-01' + CAST(date_diff('day', date '1995-01-01', CAST(l_shipdate AS DATE)) % 730 AS INTEGER) AS "DATE",
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 9999.9e0 ELSE 20e0 + l_quantity END AS "TEMP",
         20e0 + l_quantity + 100e0 * l_tax AS "MAX",
         20e0 + l_quantity - 100e0 * l_discount AS "MIN",
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 9999.9e0 ELSE 20e0 + l_quantity - l_linenumber END AS "DEWP",
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 999.9e0 ELSE 0.5e0 + (l_partkey % 130) / 2e0 END AS "VISIB",
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 999.9e0 ELSE (l_orderkey % 300) / 10e0 END AS "WDSP",
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 99.99e0 ELSE l_tax END AS "PRCP",
         CASE WHEN l_linestatus = 'F' THEN 9999.9e0 ELSE 1000e0 + l_orderkey % 40 END AS "SLP",
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 999.9e0 ELSE 990e0 + l_orderkey % 50 END AS "STP",
         '0' || CAST(l_linenumber % 2 AS VARCHAR) || '0000' AS "FRSHTT",
         CAST(l_linenumber + 2 AS INTEGER) AS "TEMP_ATTRIBUTES",
         l_orderkey AS "ROW_KEY", l_linenumber AS "ROW_LINE"
  FROM lineitem""",
    "openaq_raw": """
  SELECT location_id,
         CASE WHEN l_partkey % 97 = 0 THEN 'n/a'
              ELSE CAST(fday AS VARCHAR) || 'T' || lpad(CAST((l_linenumber * 5 + l_orderkey) % 24 AS VARCHAR), 2, '0')
                   || ':00:00' || (['+00:00', '+08:00', '-05:00'])[l_partkey % 3 + 1] END AS datetime,
         parameter,
         CASE WHEN parameter IN ('pm25', 'pm10') AND l_linenumber % 2 = 1 THEN 'mg/m³'
              WHEN parameter IN ('pm25', 'pm10') THEN 'µg/m³'
              WHEN l_linenumber % 2 = 1 THEN 'ppb' ELSE 'ppm' END AS units,
         CASE WHEN l_linenumber % 2 = 1 AND parameter IN ('pm25', 'pm10') THEN base / 1000e0
              WHEN l_linenumber % 2 = 1 THEN base * 1000e0 ELSE base END AS value,
         l_orderkey AS row_key, l_linenumber AS row_line
  FROM (
    SELECT *, CASE WHEN parameter IN ('pm25', 'pm10') THEN l_extendedprice / 400e0
                   WHEN parameter = 'co' THEN l_extendedprice / 2500e0
                   ELSE l_extendedprice / 250000e0 END
              * CASE WHEN l_partkey % 50 = 0 THEN 10e0 ELSE 1e0 END AS base
    FROM (
      SELECT *, l_suppkey AS location_id,
             (['pm25', 'pm10', 'o3', 'no2', 'so2', 'co'])[l_orderkey % 6 + 1] AS parameter,
             date '1998-01-01' + CAST(date_diff('day', date '1995-01-01', CAST(l_shipdate AS DATE)) % 730 AS INTEGER) AS fday
      FROM lineitem) a) b""",
    "hourly": """
  SELECT event_id, user_id % 25 AS location_id, ts, value AS pm25, event_type, props FROM events""",
    "experiment_results": """
  SELECT c_mktsegment AS mode, o_orderpriority AS algorithm, c_nationkey AS city_id,
         avg(o_totalprice) / 10000e0 AS val_rmse,
         avg(c_acctbal) / 1000e0 AS val_mae,
         1e0 - avg(o_totalprice) / 1000000e0 AS val_r2,
         max(o_totalprice) / 50000e0 AS test_rmse,
         stddev_samp(o_totalprice) / 10000e0 AS test_mae,
         1e0 - min(o_totalprice) / 100000e0 AS test_r2,
         CAST(count(*) AS BIGINT) AS n_train
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_mktsegment, o_orderpriority, c_nationkey""",
}

# dependencies between views (a view's CTE must follow the ones it reads)
_DEPS = {"station": ["city"], "coast_segment": ["city"]}


def with_views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` prefix defining the named domain views plus extra CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"


# --------------------------------------------------------------------------
# City pipeline (weather + air -> merged), written independently in SQL.
# Brute-force spatial join (the oracle may be naive), explicit GROUP BYs.
# --------------------------------------------------------------------------
def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(6371e0 * (2e0 * atan2(sqrt({a}), sqrt(1e0 - {a}))))"


def _wcols():
    return ["temp_avg_c", "temp_max_c", "temp_min_c", "dewpoint_c", "precip_mm", "wind_speed_kmh",
            "visibility_km", "station_pressure_hpa"]


_RANGES = {"temp_avg_c": (-60, 60), "temp_max_c": (-60, 60), "temp_min_c": (-60, 60), "precip_mm": (0, 2000),
           "wind_speed_kmh": (0, 300), "visibility_km": (0, 100), "station_pressure_hpa": (870, 1085)}
_POLL = ["pm25", "pm10", "o3", "no2", "so2", "co"]
_PRANGE = {"pm25": (0, 1000), "pm10": (0, 2000), "o3": (0, 0.5), "no2": (0, 2), "so2": (0, 1), "co": (0, 50)}


def _gsod_clean() -> str:
    checked = []
    for c in _wcols():
        if c in _RANGES:
            lo, hi = _RANGES[c]
            checked.append(f"CASE WHEN {c} BETWEEN {lo}e0 AND {hi}e0 OR {c} IS NULL THEN {c} END AS {c}")
            checked.append(f"coalesce(NOT ({c} BETWEEN {lo}e0 AND {hi}e0), false) AS {c}_is_outlier")
        else:
            checked.append(c)
    return f"""
  SELECT station_id, date, weather_flags, {', '.join(checked)}
  FROM (
    SELECT "STATION" AS station_id, "DATE" AS date,
           (nullif("TEMP", 9999.9e0) - 32e0) * 5e0 / 9e0 AS temp_avg_c,
           (nullif("MAX", 9999.9e0) - 32e0) * 5e0 / 9e0 AS temp_max_c,
           (nullif("MIN", 9999.9e0) - 32e0) * 5e0 / 9e0 AS temp_min_c,
           (nullif("DEWP", 9999.9e0) - 32e0) * 5e0 / 9e0 AS dewpoint_c,
           nullif("PRCP", 99.99e0) * 25.4e0 AS precip_mm,
           nullif("WDSP", 999.9e0) * 1.852e0 AS wind_speed_kmh,
           nullif("VISIB", 999.9e0) * 1.60934e0 AS visibility_km,
           coalesce(nullif("SLP", 9999.9e0), nullif("STP", 999.9e0)) AS station_pressure_hpa,
           "FRSHTT" AS weather_flags
    FROM gsod_raw) g"""


def _station_day() -> str:
    aggs = [f"avg({c}) AS {c}" for c in _wcols()]
    aggs += [f"bool_or({c}_is_outlier) AS {c}_is_outlier" for c in _wcols() if c in _RANGES]
    return f"""
  SELECT d.*, s.lat, s.lon, s.elev_m
  FROM (SELECT station_id, date, {', '.join(aggs)}
        FROM gsod_clean GROUP BY station_id, date) d
  LEFT JOIN active_station s ON d.station_id = s.station_id"""


def _near(radius: float, n: int) -> str:
    return f"""
  SELECT * FROM (
    SELECT city_id, station_id, distance_km,
           row_number() OVER (PARTITION BY city_id ORDER BY distance_km, station_id) AS rank
    FROM (SELECT c.city_id, s.station_id, {_hav('c.lat', 'c.lng', 's.lat', 's.lon')} AS distance_km
          FROM city c CROSS JOIN active_station s) x
    WHERE distance_km < {radius}e0) y
  WHERE rank <= {n}"""


def _idw(rows: str, cols: list[str], outliers: dict, loc: bool) -> str:
    aggs, outs = [], []
    for c in cols:
        aggs.append(f"sum(w * {c}) / sum(CASE WHEN {c} IS NOT NULL THEN w END) AS {c}")
        aggs.append(f"count({c}) AS {c}_source_count")
        outs.append(c)
        outs.append(f"CASE WHEN n_city_stations = 1 THEN CAST(1 AS BIGINT) ELSE {c}_source_count END AS {c}_source_count")
        if c in outliers:
            aggs.append(f"coalesce(bool_or({c}_is_outlier), false) AS {c}_is_outlier")
            outs.append(f"{c}_is_outlier")
    if loc:
        for c in ("lat", "lon", "elev_m"):
            aggs.append(f"arg_min({c}, CASE WHEN lat IS NOT NULL THEN rank END) AS {c}")
            outs.append(c)
    valid = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    return f"""
  SELECT city_id, date, {', '.join(outs)}, station_count,
         CASE WHEN n_city_stations = 1 THEN 'single_station' ELSE 'weighted_average' END AS data_source,
         CASE WHEN n_city_stations = 1 THEN 1e0 ELSE ({valid}) / {float(len(cols))}e0 END AS data_quality_score
  FROM (SELECT city_id, date, {', '.join(aggs)}, count(*) AS station_count, max(n_city_stations) AS n_city_stations
        FROM {rows} GROUP BY city_id, date) g"""


def _air_parsed() -> str:
    lo = "CASE " + " ".join(f"WHEN parameter = '{p}' THEN {a}e0" for p, (a, b) in _PRANGE.items()) + " ELSE 0e0 END"
    hi = "CASE " + " ".join(f"WHEN parameter = '{p}' THEN {b}e0" for p, (a, b) in _PRANGE.items()) + " ELSE 10000e0 END"
    return f"""
  SELECT location_id, datetime, parameter, units, row_key, row_line, ts_utc, date,
         CASE WHEN NOT coalesce(value < {lo} OR value > {hi}, false) THEN value END AS value,
         coalesce(value < {lo} OR value > {hi}, false) AS is_outlier
  FROM (
    SELECT *, CAST(ts_utc AS DATE) AS date,
           CASE WHEN units IS NULL OR units = tgt THEN v
                WHEN units = 'mg/m³' AND tgt = 'µg/m³' THEN v * 1000e0
                WHEN units = 'g/m³' AND tgt = 'µg/m³' THEN v * 1000000e0
                WHEN units = 'ppb' AND tgt = 'ppm' THEN v / 1000e0
                WHEN units = 'ppt' AND tgt = 'ppm' THEN v / 1000000e0
                ELSE v END AS value
    FROM (
      SELECT location_id, datetime, parameter, units, row_key, row_line,
             CAST(try_strptime(datetime, '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts_utc,
             CASE WHEN isnan(TRY_CAST(value AS DOUBLE)) THEN NULL ELSE TRY_CAST(value AS DOUBLE) END AS v,
             CASE WHEN parameter IN ('pm25', 'pm10') THEN 'µg/m³' WHEN parameter IN ('o3', 'no2', 'so2', 'co') THEN 'ppm'
                  ELSE 'µg/m³' END AS tgt
      FROM openaq_raw) a
    WHERE ts_utc IS NOT NULL AND v IS NOT NULL) b"""


def _air_location_day() -> str:
    aggs = []
    for p in _POLL:
        aggs.append(f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}")
        aggs.append(f"bool_or(CASE WHEN parameter = '{p}' THEN is_outlier END) AS {p}_is_outlier")
    return f"SELECT location_id, date, {', '.join(aggs)} FROM air_parsed GROUP BY location_id, date"


PIPELINE = {
    "active_station": ("SELECT * FROM station WHERE lat IS NOT NULL AND lon IS NOT NULL AND end_ymd >= 20200000",
                       ["station"]),
    "gsod_clean": (_gsod_clean(), ["gsod_raw"]),
    "station_day": (_station_day(), ["gsod_clean", "active_station"]),
    "near_w": (_near(50.0, 5), ["city", "active_station"]),
    "wcov": ("""
  SELECT m.city_id, d.station_id,
         (avg(CASE WHEN temp_avg_c IS NOT NULL THEN 1e0 ELSE 0e0 END)
          + avg(CASE WHEN precip_mm IS NOT NULL THEN 1e0 ELSE 0e0 END)) / 2e0 AS coverage
  FROM station_day d JOIN near_w m ON d.station_id = m.station_id
  GROUP BY m.city_id, d.station_id""", ["station_day", "near_w"]),
    "wmap": ("""
  SELECT m.* FROM near_w m
  JOIN wcov c ON m.city_id = c.city_id AND m.station_id = c.station_id
  JOIN (SELECT city_id, count(*) AS n FROM near_w GROUP BY city_id) k ON m.city_id = k.city_id
  WHERE c.coverage >= 0.3e0 OR k.n = 1""", ["near_w", "wcov"]),
    "wrows": ("""
  SELECT d.*, m.city_id, m.distance_km, m.rank, k.n_city_stations,
         1e0 / greatest(coalesce(m.distance_km, 1e0), 0.1e0) AS w
  FROM station_day d JOIN wmap m ON d.station_id = m.station_id
  JOIN (SELECT city_id, count(*) AS n_city_stations FROM wmap GROUP BY city_id) k ON m.city_id = k.city_id""",
              ["station_day", "wmap"]),
    "weather_city": (_idw("wrows", _wcols(), _RANGES, True), ["wrows"]),
    "air_parsed": (_air_parsed(), ["openaq_raw"]),
    "air_location_day": (_air_location_day(), ["air_parsed"]),
    "near_a": (_near(50.0, 20), ["city", "active_station"]),
    "arows": ("""
  SELECT d.*, m.city_id, m.distance_km, m.rank, k.n_city_stations,
         1e0 / greatest(coalesce(m.distance_km * 1000e0, 1000e0), 100e0) AS w
  FROM air_location_day d JOIN near_a m ON d.location_id = m.station_id
  JOIN (SELECT city_id, count(*) AS n_city_stations FROM near_a GROUP BY city_id) k ON m.city_id = k.city_id""",
              ["air_location_day", "near_a"]),
    "air_city": (_idw("arows", _POLL, {p: 1 for p in _POLL}, False), ["arows"]),
    "merged": ("""
  SELECT replace(c.city_name, '_', ' ') AS city_name, w.date,
         w.temp_avg_c, w.temp_max_c, w.temp_min_c, w.dewpoint_c, w.precip_mm, w.wind_speed_kmh,
         w.visibility_km, w.station_pressure_hpa,
         a.pm25, a.pm10, a.o3, a.no2, a.so2, a.co, CAST(year(w.date) AS INTEGER) AS year
  FROM weather_city w LEFT JOIN air_city a ON w.city_id = a.city_id AND w.date = a.date
  JOIN city c ON w.city_id = c.city_id""", ["weather_city", "air_city", "city"]),
}

for _name, (_sql, _deps) in PIPELINE.items():
    VIEWS[_name] = _sql
    _DEPS[_name] = _deps
_DEPS.setdefault("station", ["city"])


def r4(body: str, doubles: list[str]) -> str:
    """Round the named double columns the way ``airshed.plans.finish`` does."""
    if not doubles:
        return body
    rep = ", ".join(f'floor("{c}" * 10000e0 + 0.500123456e0) / 10000e0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"
