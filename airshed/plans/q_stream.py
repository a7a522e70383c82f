"""Registered queries: Structured Streaming (T1-T5) and hourly-feed batch operators.

Each streaming query runs its stream to completion (availableNow) and returns
the sink table; the oracle is the batch SQL of the same semantics, so the gate
checks batch = stream.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airshed.operators import timeseries as ts
from airshed.plans.oracle_views import with_views as V
from airshed.plans.registry import query
from airshed.sources import domain
from airshed.streaming import hourly as S

_H = "CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 3600) AS BIGINT)"


def _win(df, col="window"):
    return df.select("*", F.col(f"{col}.start").cast("timestamp_ntz").alias("window_start"),
                     F.col(f"{col}.end").cast("timestamp_ntz").alias("window_end")).drop(col)


@query("stream_daily_mean", V("hourly") + """
SELECT location_id, 'pm25' AS parameter, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
  avg(pm25) AS pm25_mean, count(*) AS n FROM hourly GROUP BY location_id, date_trunc('day', ts)""", ["pm25_mean"])
def stream_daily_mean(spark, d):
    """Tumbling 1-day mean per location from a file stream (watermark 2 days)."""
    return _win(S.run_to_table(S.daily_mean(S.hourly_stream(spark, d)), "daily_mean",
                              keys=["location_id", "parameter", "window"]))


@query("stream_sliding_8h", V("hourly") + """
SELECT location_id, ws AS window_start, ws + INTERVAL 8 HOUR AS window_end, avg(pm25) AS pm25_8h, count(*) AS n
FROM (SELECT location_id, pm25, date_trunc('hour', ts) - to_hours(k) AS ws
      FROM hourly, (SELECT unnest(range(8)) AS k) g) x GROUP BY location_id, ws""", ["pm25_8h"])
def stream_sliding_8h(spark, d):
    """Sliding 8-hour mean with a 1-hour slide."""
    return _win(S.run_to_table(S.sliding_8h(S.hourly_stream(spark, d)), "sliding_8h",
                              keys=["location_id", "window"]))


@query("stream_episodes", V("hourly") + """
SELECT location_id, min(ts) AS window_start, max(ts) + INTERVAL 24 HOUR AS window_end, count(*) AS n, max(pm25) AS peak
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 24 HOUR THEN 1 ELSE 0 END)
             OVER (PARTITION BY location_id ORDER BY ts, event_id) AS sid
      FROM (SELECT *, lag(ts) OVER (PARTITION BY location_id ORDER BY ts, event_id) AS prev
            FROM hourly WHERE pm25 > 35e0) a) b GROUP BY location_id, sid""", ["peak"])
def stream_episodes(spark, d):
    """Pollution episodes as session windows (PM2.5 > 35, gap 24 h)."""
    return _win(S.episodes_table(S.hourly_stream(spark, d)), "session_window")


@query("stream_dedup", V("hourly") + """
SELECT location_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
  count(DISTINCT event_id) AS n_unique FROM hourly GROUP BY location_id, date_trunc('day', ts)""")
def stream_dedup(spark, d):
    """T4: de-duplication within the watermark, then per-day unique counts."""
    return _win(S.run_to_table(S.dedup_counts(S.hourly_stream(spark, d)), "dedup",
                              keys=["location_id", "window"]))


def _nowcast_sql() -> str:
    lags = ["c"] + [f"lag(c, {i}) OVER (PARTITION BY location_id ORDER BY hour_idx)" for i in range(1, 12)]
    cs = [f"c{i}" for i in range(12)]
    wt = f"CASE WHEN greatest({', '.join(cs)}) = 0 THEN 1e0 ELSE greatest(0.5e0, least({', '.join(cs)}) / greatest({', '.join(cs)})) END"
    num = " + ".join(f"CASE WHEN c{i} IS NOT NULL THEN pow(wt, {i}e0) * c{i} ELSE 0e0 END" for i in range(12))
    den = " + ".join(f"CASE WHEN c{i} IS NOT NULL THEN pow(wt, {i}e0) ELSE 0e0 END" for i in range(12))
    recent = " + ".join(f"CAST(c{i} IS NOT NULL AS INTEGER)" for i in range(3))
    return f"""
SELECT location_id, hour_idx, CASE WHEN {recent} >= 2 THEN ({num}) / ({den}) END AS nowcast FROM (
  SELECT *, {wt} AS wt FROM (
    SELECT location_id, hour_idx, {', '.join(f'{lg} AS c{i}' for i, lg in enumerate(lags))} FROM (
      SELECT s.location_id, s.hour_idx, h.c FROM (
        SELECT location_id, unnest(range(min(hour_idx), max(hour_idx) + 1)) AS hour_idx FROM hm GROUP BY location_id) s
      LEFT JOIN hm h ON s.location_id = h.location_id AND s.hour_idx = h.hour_idx) sp) l) x
WHERE c0 IS NOT NULL"""


_HM = f"SELECT location_id, {_H} AS hour_idx, avg(pm25) AS c FROM hourly GROUP BY location_id, {_H}"


@query("nowcast_pm", V("hourly", extra=[("hm", _HM)]) + _nowcast_sql(), ["nowcast"])
def nowcast_pm(spark, d):
    """NowCast per location-hour over an hourly spine (batch)."""
    return ts.nowcast(domain.hourly(spark, d))


@query("stream_nowcast", V("hourly", extra=[("hm", _HM)]) + _nowcast_sql(), ["nowcast"])
def stream_nowcast(spark, d):
    """T5: running NowCast per location, emitted by the stream from its keyed state."""
    return S.nowcast_table(S.hourly_stream(spark, d))


@query("ozone_8h_max", V("hourly", extra=[("hm", _HM)]) + """
SELECT location_id, CAST(to_timestamp(hour_idx * 3600) AT TIME ZONE 'UTC' AS DATE) AS date, max(a8) AS max_8h_mean
FROM (SELECT location_id, hour_idx, avg(c) OVER (PARTITION BY location_id ORDER BY hour_idx
        RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS a8 FROM hm) x
GROUP BY location_id, CAST(to_timestamp(hour_idx * 3600) AT TIME ZONE 'UTC' AS DATE)""", ["max_8h_mean"])
def ozone_8h_max(spark, d):
    """8-hour running mean of the hourly feed and its daily maximum."""
    return ts.rolling_8h_daily_max(domain.hourly(spark, d))


_TZ = ["UTC", "Asia/Shanghai", "America/New_York"]


@query("local_day", V("hourly") + """
SELECT event_id, location_id, CAST(ts AS DATE) AS utc_day,
  CAST(timezone(tz, timezone('UTC', ts)) AS DATE) AS local_day FROM (
  SELECT *, (['UTC', 'Asia/Shanghai', 'America/New_York'])[location_id % 3 + 1] AS tz FROM hourly) x""")
def local_day(spark, d):
    """UTC timestamp -> local calendar day with the location's time zone."""
    h = domain.hourly(spark, d)
    tz = F.element_at(F.array(*[F.lit(z) for z in _TZ]), (F.col("location_id") % 3 + 1).cast("int"))
    t = F.col("ts").cast("timestamp")
    return h.select("event_id", "location_id", F.to_date(t).alias("utc_day"),
                    F.to_date(F.from_utc_timestamp(t, tz)).alias("local_day"))


@query("stream_late_data")
def stream_late_data(spark, d):
    """T4: late-data accounting -- the hourly feed lands as one file per day with every fifth day
    arriving four days late; per micro-batch the input rows and the rows dropped by the 2-day
    watermark (streaming progress metrics).  Rows-only (depends on arrival order)."""
    import uuid
    from airshed.session import checkpoint_dir
    ev = domain.table(spark, d, "events")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/landing/hourly-{uuid.uuid4().hex}"
    S.land_daily_files(ev, folder)
    report = S.late_data_report(spark, folder, ev.schema)
    S._drop(spark, folder)
    return report
