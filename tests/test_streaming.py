"""Streams over many micro-batches equal their batch twins."""

import tempfile

import pytest
from pyspark.sql import functions as F

from airshed.operators import timeseries as ts
from airshed.sources import domain
from airshed.streaming import hourly as S


@pytest.fixture(scope="module")
def landing(spark, sf_small):
    """The hourly feed written as one file per day (files 'land' in event-time order)."""
    d = tempfile.mkdtemp(prefix="airshed-stream-")
    ev = domain.table(spark, sf_small, "events")
    days = sorted(r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())
    for i, day in enumerate(days):
        ev.where(F.to_date("ts") == F.lit(day)).coalesce(1).write.parquet(f"{d}/part-{i:03d}")
    # flatten into one folder of files
    import glob
    import os
    import shutil
    flat = tempfile.mkdtemp(prefix="airshed-stream-flat-")
    import time
    t0 = time.time() - 10000
    for i, f in enumerate(sorted(glob.glob(f"{d}/part-*/*.parquet"))):
        dst = os.path.join(flat, f"events-{i:03d}.parquet")
        shutil.copy(f, dst)
        os.utime(dst, (t0 + 60 * i, t0 + 60 * i))   # files land in day order
    return flat


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_daily_mean_multi_batch(spark, landing, sf_small):
    stream = S.hourly_stream(spark, landing, file_glob="events-*.parquet", max_files=1)
    out = S.run_to_table(S.daily_mean(stream), "t_daily", keys=["location_id", "window"])
    got = out.select("location_id", F.col("window.start").alias("s"), "pm25_mean", "n")
    h = domain.hourly(spark, sf_small).select("location_id", F.col("ts").cast("timestamp").alias("ts"), "pm25")
    exp = h.groupBy("location_id", F.window("ts", "1 day")).agg(F.avg("pm25").alias("pm25_mean"),
                                                                F.count("*").alias("n")) \
        .select("location_id", F.col("window.start").alias("s"), "pm25_mean", "n")
    assert _rows(got, ["location_id", "s", "pm25_mean", "n"]) == _rows(exp, ["location_id", "s", "pm25_mean", "n"])


def test_nowcast_state_across_batches(spark, landing, sf_small):
    stream = S.hourly_stream(spark, landing, file_glob="events-*.parquet", max_files=1)
    out = S.nowcast_table(stream)
    assert out.count() == out.select("location_id", "hour_idx").distinct().count()
    got = out
    exp = ts.nowcast(domain.hourly(spark, sf_small))
    cols = ["location_id", "hour_idx", "nowcast"]
    assert _rows(got, cols) == _rows(exp, cols)


def test_dedup_within_watermark(spark, landing, sf_small):
    stream = S.hourly_stream(spark, landing, file_glob="events-*.parquet", max_files=2)
    doubled = stream.unionByName(stream)          # every event delivered twice
    out = S.run_to_table(S.dedup_counts(doubled), "t_dedup", keys=["location_id", "window"])
    total = out.agg(F.sum("n_unique")).first()[0]
    assert total == domain.table(spark, sf_small, "events").count()


def test_late_data_accounting(spark, sf_small):
    from airshed.plans.registry import QUERIES, load_all
    load_all()
    rep = QUERIES["stream_late_data"](spark, sf_small).collect()
    assert all(r.input_rows == r.accepted_rows + r.dropped_late for r in rep)
    assert sum(r.input_rows for r in rep) == domain.table(spark, sf_small, "events").count()
    # only whole late-landed days are dropped; every on-time batch is accepted in full
    for r in rep:
        assert r.dropped_late in (0, r.input_rows)
    assert any(r.dropped_late > 0 for r in rep)


def _feed(spark, sf_small):
    return domain.hourly(spark, sf_small).withColumn("ts", F.col("ts").cast("timestamp"))


def _land(frames, folder):
    """One file for each frame, in landing order."""
    import glob
    import os
    for i, df in enumerate(frames):
        d = tempfile.mkdtemp(prefix="airshed-land-")
        df.coalesce(1).write.mode("overwrite").parquet(d)
        src = glob.glob(f"{d}/*.parquet")[0]
        dst = os.path.join(folder, f"events-{len(glob.glob(folder + '/events-*')):03d}.parquet")
        with open(src, "rb") as a, open(dst, "wb") as b:
            b.write(a.read())
        t = 1_600_000_000 + 60 * len(glob.glob(folder + "/events-*"))
        os.utime(dst, (t, t))


def _split_days(spark, sf_small, n):
    """Events cut at times that fall inside days (and hours)."""
    ev = domain.table(spark, sf_small, "events")
    lo, hi = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    step = (hi - lo) // n + 1
    return [ev.where((t >= lo + i * step) & (t < lo + (i + 1) * step)) for i in range(n)]


def test_nowcast_when_files_split_hours(spark, sf_small):
    folder = tempfile.mkdtemp(prefix="airshed-split-")
    _land(_split_days(spark, sf_small, 17), folder)
    out = S.nowcast_table(S.hourly_stream(spark, folder, file_glob="events-*.parquet", max_files=1))
    cols = ["location_id", "hour_idx", "nowcast"]
    assert out.count() == out.select("location_id", "hour_idx").distinct().count()
    assert _rows(out, cols) == _rows(ts.nowcast(domain.hourly(spark, sf_small)), cols)


def test_episodes_over_batches_equal_batch_sessions(spark, sf_small):
    folder = tempfile.mkdtemp(prefix="airshed-episodes-")
    _land(_split_days(spark, sf_small, 9), folder)
    feed = _feed(spark, sf_small)
    cols = ["location_id", "session_window", "n", "peak"]
    stream = S.episodes(S.hourly_stream(spark, folder, file_glob="events-*.parquet", max_files=1))
    path = tempfile.mkdtemp(prefix="airshed-sessions-")
    closed = S.run_to_table(stream, "closed", mode="append", keys=["location_id", "session_window"], path=path)
    still = S.open_sessions(spark, f"{path}/checkpoint", cols)
    assert closed.count() and still.count()  # both ways are met, and no session comes by both
    assert not set(_rows(closed, cols)) & set(_rows(still, cols))
    out = S.episodes_table(S.hourly_stream(spark, folder, file_glob="events-*.parquet", max_files=1))
    assert _rows(out, cols) == _rows(S.episodes(feed), cols)


def test_restart_and_replay(spark, sf_small):
    """A run with a path goes on after its last batch; a batch that is replayed writes its rows once."""
    folder, path = tempfile.mkdtemp(prefix="airshed-restart-"), tempfile.mkdtemp(prefix="airshed-state-")
    parts = _split_days(spark, sf_small, 6)
    keys = ["location_id", "parameter", "window"]
    run = lambda: S.run_to_table(S.daily_mean(S.hourly_stream(spark, folder, file_glob="events-*.parquet", max_files=1)), "t", keys=keys, path=path)
    _land(parts[:3], folder)
    run()
    _land(parts[3:], folder)
    out = run()
    feed = _feed(spark, sf_small).withColumn("parameter", F.lit("pm25"))
    exp = feed.groupBy("location_id", "parameter", F.window("ts", "1 day")).agg(F.avg("pm25").alias("pm25_mean"), F.count("*").alias("n"))
    cols = [*keys, "pm25_mean", "n"]
    assert _rows(out, cols) == _rows(exp, cols)
    # the same batch again (as after a crash between the sink and the commit)
    sink = S._batches(f"{path}/data")
    last = spark.read.parquet(f"{path}/data/_batch=2")
    n = last.count()
    sink(last.checkpoint(), 2)
    assert spark.read.parquet(f"{path}/data/_batch=2").count() == n


def test_late_data_accounting_does_not_depend_on_the_progress_limit(spark, sf_small):
    from airshed.plans.registry import QUERIES, load_all
    load_all()
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        rep = QUERIES["stream_late_data"](spark, sf_small).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sum(r.input_rows for r in rep) == domain.table(spark, sf_small, "events").count()
    assert any(r.dropped_late > 0 for r in rep)


def _hours(spark, rows):
    """(event_id, user_id, ts, value) rows as the feed's files hold them."""
    return spark.createDataFrame([(k, loc, "2020-01-01 00:00:00", hour, v) for k, (loc, hour, v) in enumerate(rows)], "event_id long, user_id long, t string, h double, value double") \
        .select("event_id", "user_id", (F.col("t").cast("timestamp") + F.make_interval(secs=F.col("h") * 3600)).cast("timestamp_ntz").alias("ts"), "value")


def _stream_of(spark, folder):
    return S.hourly_stream(spark, folder, file_glob="events-*.parquet", max_files=1)


def test_nowcast_restart_and_late_rows(spark):
    folder, path = tempfile.mkdtemp(prefix="airshed-nowcast-"), tempfile.mkdtemp(prefix="airshed-ring-")
    first = [(1, h + 0.1, 10.0 + h) for h in range(20)] + [(2, 3.5, 7.0), (2, 4.5, None), (1, 19.9, 1.0)]
    again = [(1, 5.2, 99.0), (1, 60.0, 5.0), (1, 61.0, 6.0)]  # hour 5 is late but within two days
    far = [(1, 200.0, 1.0)]
    late = [(1, 6.0, 1e6), (1, 199.0, 3.0)]  # hour 6 is closed by now
    _land([_hours(spark, first), _hours(spark, again)], folder)
    S.nowcast_table(_stream_of(spark, folder), path=path)
    _land([_hours(spark, far), _hours(spark, late)], folder)
    out = S.nowcast_table(_stream_of(spark, folder), path=path)
    kept = [r for r in first + again + far + late if r != (1, 6.0, 1e6)]
    feed = _hours(spark, kept).select(F.col("user_id").alias("location_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("pm25"))
    cols = ["location_id", "hour_idx", "nowcast"]
    key = lambda rows: sorted(rows, key=str)
    got = key(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.select(*cols).collect())
    exp = key(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in ts.nowcast(feed).select(*cols).collect())
    assert got == exp and any(r[2] is None for r in got) and any(r[2] is not None for r in got)
    # The ring is bounded: what the state holds is the hours after the watermark and eleven more; location 2 has timed out.
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    assert state.count() == 1


def test_nowcast_weights():
    assert S.weighted([None, None, 3.0]) is None and S.weighted([1.0]) is None and S.weighted([0.0, 0.0, 0.0]) == 0.0
    assert S.weighted([4.0, 4.0]) == 4.0 and S.weighted([2.0, None, 8.0]) == (2 + 0.25 * 8) / 1.25
    assert abs(S.weighted([9.0, 10.0, None, 10.0]) - (9 + 9 + 0.729 * 10) / (1 + 0.9 + 0.729)) < 1e-12
