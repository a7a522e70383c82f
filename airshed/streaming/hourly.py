"""Structured Streaming over the hourly measurement feed.

Sources are files landing in a folder, triggers are ``availableNow``: a run processes what has
landed and stops.  ``run_to_table`` keeps a query's checkpoint and its rows under one path.
With a path given by the caller, a restarted run resumes after the last committed micro-batch;
every micro-batch writes a folder of its own, overwritten when the batch is replayed, so rows
are neither lost nor doubled.  Aggregates run in update mode and sessions in append mode, so
the watermark bounds the state.

T1  tumbling 1-day mean per location and parameter (watermark 2 days)
T2  sliding 8-hour mean, 1-hour slide
T3  session windows: pollution episodes (PM2.5 > 35, gap 24 h); those still open are read from the stream's state
T4  de-duplication within the watermark + per-day counts, late-data accounting
T5  running NowCast: keyed state with the hourly sums of each location, from which the stream emits
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from airshed.constants import HIGH_POLLUTION
from airshed.session import checkpoint_dir

WATERMARK = "2 days"


def hourly_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet",
                  max_files: int | None = None) -> DataFrame:
    """Hourly feed as a stream: location = user_id % 25, PM2.5 = value, event time = ts (UTC)."""
    schema = spark.read.parquet(f"{folder}/{file_glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    s = reader.parquet(folder)
    return s.select("event_id", (F.col("user_id") % 25).alias("location_id"), F.lit("pm25").alias("parameter"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("pm25"))


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _run(df: DataFrame, mode: str, sink, checkpoint: str) -> None:
    q = (df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def _batches(path: str):
    """A sink with a folder for each micro-batch; a replayed batch overwrites its own."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={epoch}")
    return sink


def _landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches' rows with their batch id (no rows if no batch was written)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = StructType([*schema.fields, StructField("_batch", LongType())])
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def run_to_table(df: DataFrame, name: str, mode: str = "update", keys: list[str] | None = None,
                 path: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all that has landed and return its rows.

    The latest emission per ``keys`` wins in every mode; without keys all emitted rows are
    returned.  ``path`` holds the checkpoint and the rows, and a later run with the same path
    goes on from there.  Without one, a run-scoped folder serves this run alone: its rows are
    checkpointed and the folder is removed."""
    spark = df.sparkSession
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    _run(df, mode, _batches(f"{base}/data"), f"{base}/checkpoint")
    res = _landed(spark, f"{base}/data", df.schema)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
        res = res.select("*", F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")
    res = res.drop("_batch")
    if path is None:
        res = res.checkpoint()
        _drop(spark, base)
    return res


def daily_mean(stream: DataFrame) -> DataFrame:
    w = stream.withWatermark("ts", WATERMARK).groupBy("location_id", "parameter", F.window("ts", "1 day"))
    return w.agg(F.avg("pm25").alias("pm25_mean"), F.count("*").alias("n"))


def sliding_8h(stream: DataFrame) -> DataFrame:
    w = stream.withWatermark("ts", WATERMARK).groupBy("location_id", F.window("ts", "8 hours", "1 hour"))
    return w.agg(F.avg("pm25").alias("pm25_8h"), F.count("*").alias("n"))


def episodes(rows: DataFrame, threshold: float = HIGH_POLLUTION, gap: str = "24 hours") -> DataFrame:
    """Sessions of high values; of a stream (with the watermark) or of a table."""
    high = rows.where(F.col("pm25") > F.lit(threshold))
    if rows.isStreaming:
        high = high.withWatermark("ts", WATERMARK)
    return high.groupBy("location_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("n"), F.max("pm25").alias("peak"))


def open_sessions(spark: SparkSession, checkpoint: str, columns) -> DataFrame:
    """The sessions that a stream's state holds after its last batch (none if it never kept any)."""
    state = spark.read.format("statestore").load(checkpoint)
    value = {f.name for f in state.schema["value"].dataType.fields}
    key = {f.name for f in state.schema["key"].dataType.fields}
    picked = {"location_id": "key.location_id", "session_window": "value.session_window" if "session_window" in value else "key.session_window",
              "n": "value.count", "peak": "value.max"}
    return state.select(*[F.col(picked[c] if c in picked else f"key.{c}" if c in key else f"value.{c}").alias(c) for c in columns])


def episodes_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """All episodes of what has landed: the stream emits those that the watermark has closed (append
    mode), and those still open are its state, read by the state data source.  The feed is read once."""
    spark = stream.sparkSession
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/streams/episodes-{uuid.uuid4().hex}"
    df = episodes(stream)
    closed = run_to_table(df, "episodes", mode="append", keys=["location_id", "session_window"], path=base)
    out = closed.unionByName(open_sessions(spark, f"{base}/checkpoint", df.columns))
    if path is None:
        out = out.checkpoint()
        _drop(spark, base)
    return out


def dedup_counts(stream: DataFrame) -> DataFrame:
    d = stream.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    return d.groupBy("location_id", F.window("ts", "1 day")).agg(F.count("*").alias("n_unique"))


# ----------------------------------------------------------- T5 NowCast
NOWCAST_HOURS = 12
HOUR_MS = 3_600_000
HOUR_SUMS = "location_id long, hour_idx long, total double, n long, latest timestamp"
NOWCASTS = "location_id long, hour_idx long, nowcast double"
RING = "hours array<long>, totals array<double>, counts array<long>"


def hour_sums(stream: DataFrame) -> DataFrame:
    """Sums of each location-hour within a task's batch of rows, so that a busy location moves few rows; latest is their last event time."""
    def combine(frames):
        for pdf in frames:
            if len(pdf):
                g = pdf.groupby(["location_id", "hour_idx"], as_index=False)
                yield g.agg(total=("pm25", "sum"), n=("pm25", "count"), latest=("ts", "max"))

    hour = F.floor(F.unix_timestamp("ts") / 3600).alias("hour_idx")
    rows = stream.where("ts IS NOT NULL AND location_id IS NOT NULL").select("location_id", hour, "ts", "pm25")
    return rows.mapInPandas(combine, HOUR_SUMS)


def weighted(values: list) -> float | None:
    """NowCast of up to twelve hourly means, newest first (None: no mean)."""
    there = [v for v in values if v is not None]
    if sum(v is not None for v in values[:3]) < 2:
        return None
    low, high = min(there), max(there)
    w = 1.0 if high == 0 else max(0.5, low / high)
    top = sum(w**i * v for i, v in enumerate(values) if v is not None)
    return top / sum(w**i for i, v in enumerate(values) if v is not None)


def _nowcast_state(key, frames, state):
    """One location's step: adds the batch's sums to the ring and gives the NowCast of every hour that they change.

    The ring holds the hours that the watermark still admits and the eleven before them.  Rows of closed hours are
    late and dropped, as a window aggregate would.  A timer removes the ring once no later hour can need it."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    ring: dict = {}
    if state.exists:
        hours, totals, counts = state.get
        ring = {int(h): [float(t), int(c)] for h, t, c in zip(hours, totals, counts)}
    bound = state.getCurrentWatermarkMs()
    changed = set()
    for pdf in frames:
        for hour, total, n in zip(pdf["hour_idx"].tolist(), pdf["total"].tolist(), pdf["n"].tolist()):
            if n and (hour + 1) * HOUR_MS > bound:
                held = ring.setdefault(hour, [0.0, 0])
                held[0] += total
                held[1] += n
                changed.add(hour)
    due = sorted({h + k for h in changed for k in range(NOWCAST_HOURS)} & ring.keys())
    mean = {h: t / c for h, (t, c) in ring.items()}
    made = [weighted([mean.get(h - i) for i in range(NOWCAST_HOURS)]) for h in due]
    oldest = bound // HOUR_MS - NOWCAST_HOURS + 1
    kept = sorted(h for h in ring if h >= oldest)
    if kept:
        state.update((kept, [ring[h][0] for h in kept], [ring[h][1] for h in kept]))
        state.setTimeoutTimestamp(max((kept[-1] + NOWCAST_HOURS + 1) * HOUR_MS, bound + 1))
    elif state.exists:
        state.remove()
    if due:
        yield pd.DataFrame({"location_id": [key[0]] * len(due), "hour_idx": due, "nowcast": pd.Series(made, dtype="float64")})


def nowcast_stream(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """NowCast rows in update mode: an hour is emitted when it or one of the eleven before it changes."""
    sums = hour_sums(stream).withWatermark("latest", watermark)
    return sums.groupBy("location_id").applyInPandasWithState(_nowcast_state, NOWCASTS, RING, "update", "EventTimeTimeout")


def nowcast_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """The latest NowCast of every location-hour that the stream has emitted; equal to the batch NowCast of the accepted rows."""
    return run_to_table(nowcast_stream(stream), "nowcast", keys=["location_id", "hour_idx"], path=path)


# --------------------------------------------------------- T4 late data
def land_daily_files(hourly_df: DataFrame, folder: str, late_every: int = 5, delay: int = 4) -> list[str]:
    """Write the feed as one Parquet file per event day into ``folder``; every ``late_every``-th
    day lands after the ``delay`` days that follow it (late data).  Returns the landing order.
    Late input is filtered against the previous batch's watermark, so with a 2-day watermark a
    day must land more than 3 days late before its rows are dropped.

    One write for all days; the files' times then give the landing order."""
    spark = hourly_df.sparkSession
    days = [r[0] for r in hourly_df.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]  # calendar days
    order = list(days)
    for i in range(0, len(days), late_every):
        if i + delay < len(days):
            d = order.pop(order.index(days[i]))
            order.insert(order.index(days[i + delay]) + 1, d)
    place = spark.createDataFrame([(d, k) for k, d in enumerate(order)], "_day date, batch int")
    (hourly_df.withColumn("_day", F.to_date("ts")).join(place, "_day").drop("_day")
     .repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(folder))
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(len(order)):
        for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={k}")):
            fs.setTimes(f.getPath(), 1_600_000_000_000 + 60_000 * k, -1)
    return [str(d) for d in order]


def late_data_report(spark: SparkSession, folder: str, schema, watermark: str = WATERMARK) -> DataFrame:
    """Stream the landed files one per micro-batch through a watermarked 1-day window count and
    account, per batch, for input rows, rows accepted into windows and rows dropped as too late.

    A stream without state counts every batch's input rows and its latest event time; the
    aggregation runs in update mode, and the increments of the windows' counts are the accepted
    rows of each batch (input - accepted = dropped by the watermark)."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/late-{uuid.uuid4().hex}"
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
         .select((F.col("user_id") % 25).alias("location_id"), F.col("ts").cast("timestamp").alias("ts")))

    def count(batch: DataFrame, epoch: int) -> None:
        batch.agg(F.count(F.lit(1)).alias("input_rows"), F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{base}/input/_batch={epoch}")

    _run(s, "append", count, f"{base}/input_checkpoint")
    agg = s.withWatermark("ts", watermark).groupBy("location_id", F.window("ts", "1 day")).count()
    _run(agg, "update", _batches(f"{base}/data"), f"{base}/checkpoint")
    came = spark.read.schema("input_rows long, latest timestamp, _batch long").parquet(f"{base}/input")
    out = _landed(spark, f"{base}/data", agg.schema)
    w = Window.partitionBy("location_id", "window").orderBy("_batch")
    inc = out.select("_batch", (F.col("count") - F.coalesce(F.lag("count").over(w), F.lit(0))).alias("inc"))
    accepted = inc.groupBy("_batch").agg(F.sum("inc").cast("long").alias("accepted_rows"))
    # One row for each micro-batch: bounded by the number of landed files.
    before = Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("latest").over(before) - F.expr(f"INTERVAL {watermark}")
    res = came.withColumn("watermark", seen).join(accepted, "_batch", "left").select(
        F.col("_batch").alias("batch_id"), "input_rows", F.coalesce("accepted_rows", F.lit(0)).cast("long").alias("accepted_rows"),
        (F.col("input_rows") - F.coalesce("accepted_rows", F.lit(0))).cast("long").alias("dropped_late"),
        F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark")).checkpoint()
    _drop(spark, base)
    return res
