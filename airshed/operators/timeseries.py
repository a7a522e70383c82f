"""Per-city time-series operators over one window spec.

Every operator uses ``Window.partitionBy(key).orderBy(date)`` and differs
only in frames, so Catalyst plans a single hash exchange on the key and a
single sort for all of them.  Frames that end at ``-1`` never read the current
or a later row (no look-ahead); partitioning by city keeps windows from
crossing city boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airshed.functions.units import snap
from airshed.constants import (
    INTERPOLATE_LIMIT,
    ROLL_MEAN_WINDOWS,
    ROLL_STD_WINDOWS,
    TARGET_LAGS,
    WEATHER_LAG_COLS,
)

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing


def spec(key: str = "city_name", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def calendar_columns(value: str, key: str = "city_name", date: str = "date") -> list[Column]:
    """Lags and past-only rolling means by calendar days instead of rows (one row per key and day)."""
    w = Window.partitionBy(key).orderBy(F.unix_date(date))
    lags = [F.max(value).over(w.rangeBetween(-k, -k)).alias(f"{value}_lag{k}d") for k in TARGET_LAGS]
    return lags + [F.avg(value).over(w.rangeBetween(-k, -1)).alias(f"{value}_roll{k}d_mean") for k in ROLL_MEAN_WINDOWS]


def lag_columns(targets: list[str], key: str = "city_name", lags=TARGET_LAGS,
                weather_lags=WEATHER_LAG_COLS) -> list[Column]:
    w = spec(key)
    cols = [F.lag(t, k).over(w).alias(f"{t}_lag{k}") for t in targets for k in lags]
    cols += [F.lag(c, 1).over(w).alias(f"{c}_lag1") for c in weather_lags]
    return cols


def rolling_columns(targets: list[str], key: str = "city_name", means=ROLL_MEAN_WINDOWS,
                    stds=ROLL_STD_WINDOWS) -> list[Column]:
    """Past-only rolling mean/std: frame (-k, -1), at least one value, sample std."""
    w = spec(key)
    cols = []
    for t in targets:
        cols += [F.avg(t).over(w.rowsBetween(-k, -1)).alias(f"{t}_roll{k}_mean") for k in means]
        cols += [F.stddev_samp(t).over(w.rowsBetween(-k, -1)).alias(f"{t}_roll{k}_std") for k in stds]
    return cols


def future_target(target: str, h: int, key: str = "city_name") -> Column:
    return F.lead(target, h).over(spec(key)).alias(f"{target}_future_{h}d")


def _neighbours(c: str, w, position: Column, day: Column, key: str, date: str):
    """Previous / next non-NULL value of ``c`` with its position and day.

    Both directions use running frames (unbounded preceding .. current row); the "next" side runs
    over the descending order.  A frame ending at unbounded following would be re-evaluated for
    every row (quadratic in the partition size); this stays linear, at the cost of one more sort
    over the same partitioning (no extra exchange)."""
    back = w.rowsBetween(UNB, 0)
    rev = Window.partitionBy(key).orderBy(F.col(date).desc()).rowsBetween(UNB, 0)
    present = F.col(c).isNotNull()
    return dict(
        prev_v=F.last(F.col(c), ignorenulls=True).over(back),
        prev_p=F.last(F.when(present, position), ignorenulls=True).over(back),
        prev_d=F.last(F.when(present, day), ignorenulls=True).over(back),
        next_v=F.last(F.col(c), ignorenulls=True).over(rev),
        next_p=F.last(F.when(present, position), ignorenulls=True).over(rev),
        next_d=F.last(F.when(present, day), ignorenulls=True).over(rev),
    )


def interpolate_linear(df: DataFrame, cols: list[str], key: str = "city_name", date: str = "date") -> DataFrame:
    """Linear by row position inside the key; edges held (backfill head, forward-fill tail)."""
    w = spec(key, date)
    base = df.select("*", F.row_number().over(w).alias("_pos"))
    pos = F.col("_pos")
    out = []
    for c in cols:
        n = _neighbours(c, w, pos, pos, key, date)
        lin = n["prev_v"] + (n["next_v"] - n["prev_v"]) * (pos - n["prev_p"]) / (n["next_p"] - n["prev_p"])
        filled = F.coalesce(F.col(c), lin, n["prev_v"], n["next_v"])
        out.append(filled.alias(c))
    return base.select(*[F.col(c) for c in df.columns if c not in cols], *out)


def interpolate_time_limit(df: DataFrame, cols: list[str], key: str = "city_name", date: str = "date",
                           limit: int = INTERPOLATE_LIMIT) -> DataFrame:
    """Time-weighted interpolation, forward only: at most ``limit`` consecutive rows per gap are
    filled (longer gaps partially), the tail is extended up to ``limit`` rows, the head untouched.
    Adds ``{c}_interpolated`` flags."""
    w = spec(key, date)
    base = df.select("*", F.row_number().over(w).alias("_pos"), F.unix_date(F.col(date)).alias("_day"))
    pos, day = F.col("_pos"), F.col("_day")
    out = []
    for c in cols:
        n = _neighbours(c, w, pos, day, key, date)
        inside = n["prev_v"] + (n["next_v"] - n["prev_v"]) * (day - n["prev_d"]) / (n["next_d"] - n["prev_d"])
        gap_rank = pos - n["prev_p"]
        fill = F.when(F.col(c).isNull() & n["prev_v"].isNotNull() & (gap_rank <= limit),
                      F.coalesce(inside, n["prev_v"]))
        out.append(F.coalesce(F.col(c), fill).alias(c))
        out.append((F.col(c).isNull() & fill.isNotNull()).alias(f"{c}_interpolated"))
    return base.select(*[F.col(x) for x in df.columns if x not in cols], *out)


def streaks(value: str, threshold: float, key: str = "city_name") -> list[Column]:
    """High-value streak length ending at each row, day-over-day direction, rising streak
    (gaps-and-islands: island id = running count of breaks)."""
    w = spec(key)
    high = F.coalesce(snap(F.col(value)) > F.lit(threshold), F.lit(False))
    island = F.sum(F.when(high, 0).otherwise(1)).over(w.rowsBetween(UNB, 0))
    prev = F.lag(value, 1).over(w)
    rising = F.coalesce(F.col(value) > prev, F.lit(False))
    rise_island = F.sum(F.when(rising, 0).otherwise(1)).over(w.rowsBetween(UNB, 0))
    direction = F.when(prev.isNull() | F.col(value).isNull(), F.lit(None).cast("int")) \
        .otherwise(F.signum(F.col(value) - prev).cast("int"))
    return [high.alias("_high"), island.alias("_island"), rising.alias("_rising"), rise_island.alias("_rise_island"),
            direction.alias("direction")]


def streak_lengths(df: DataFrame, value: str, threshold: float, key: str = "city_name") -> DataFrame:
    tmp = df.select("*", *streaks(value, threshold, key))
    w_island = Window.partitionBy(key, "_island").orderBy("date")
    w_rise = Window.partitionBy(key, "_rise_island").orderBy("date")
    high_streak = F.when(F.col("_high"), F.sum(F.col("_high").cast("int")).over(w_island.rowsBetween(UNB, 0))) \
        .otherwise(F.lit(0)).cast("int")
    rise_streak = F.when(F.col("_rising"), F.sum(F.col("_rising").cast("int")).over(w_rise.rowsBetween(UNB, 0))) \
        .otherwise(F.lit(0)).cast("int")
    return tmp.select(*df.columns, "direction", high_streak.alias("high_streak"), rise_streak.alias("rise_streak"))


def days_since(cond: Column, key: str = "city_name", date: str = "date") -> Column:
    """Days since the last earlier row where ``cond`` held (NULL if never)."""
    w = spec(key, date).rowsBetween(UNB, -1)
    last_day = F.last(F.when(cond, F.col(date)), ignorenulls=True).over(w)
    return F.datediff(F.col(date), last_day)


# --------------------------------------------------------------- hourly feed
def hourly_means(hourly: DataFrame, key: str = "location_id", ts_col: str = "ts", value: str = "pm25") -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col(ts_col).cast("timestamp")) / 3600).cast("long")
    return hourly.groupBy(key, hour.alias("hour_idx")).agg(F.avg(value).alias("c"))


def nowcast(hourly: DataFrame, key: str = "location_id", hours: int = 12) -> DataFrame:
    """EPA NowCast per hour with data: w = max(0.5, min/max) over the last 12 hours,
    sum(w^i c_i) / sum(w^i) over present hours, and at least 2 of the last 3 hours present.
    Missing hours are rows of an hourly spine (so lags are hours, not rows)."""
    return nowcast_hours(hourly_means(hourly, key), key, hours)


def nowcast_hours(hr: DataFrame, key: str = "location_id", hours: int = 12) -> DataFrame:
    """``nowcast`` of hourly means (key, hour_idx, c)."""
    bounds = hr.groupBy(key).agg(F.min("hour_idx").alias("_lo"), F.max("hour_idx").alias("_hi"))
    spine = bounds.select(key, F.explode(F.sequence("_lo", "_hi")).alias("hour_idx"))
    s = spine.join(hr, [key, "hour_idx"], "left")
    w = Window.partitionBy(key).orderBy("hour_idx")
    lags = [F.col("c")] + [F.lag("c", i).over(w) for i in range(1, hours)]
    s = s.select(key, "hour_idx", *[lg.alias(f"_c{i}") for i, lg in enumerate(lags)])
    cs = [F.col(f"_c{i}") for i in range(hours)]
    hi, lo = F.greatest(*cs), F.least(*cs)
    wt = F.when(hi == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), lo / hi))
    num = None
    den = None
    for i, c in enumerate(cs):
        t_num = F.when(c.isNotNull(), F.pow(wt, F.lit(float(i))) * c).otherwise(F.lit(0.0))
        t_den = F.when(c.isNotNull(), F.pow(wt, F.lit(float(i)))).otherwise(F.lit(0.0))
        num = t_num if num is None else num + t_num
        den = t_den if den is None else den + t_den
    recent = sum(c.isNotNull().cast("int") for c in cs[:3])
    return s.where(F.col("_c0").isNotNull()).select(key, "hour_idx", F.when(recent >= 2, num / den).alias("nowcast"))


def rolling_8h_daily_max(hourly: DataFrame, key: str = "location_id") -> DataFrame:
    """8-hour running mean (range frame over hour index, hours present) and its daily maximum."""
    hr = hourly_means(hourly, key)
    w = Window.partitionBy(key).orderBy("hour_idx").rangeBetween(-7, 0)
    r = hr.select(key, "hour_idx", F.avg("c").over(w).alias("avg8h"))
    day = F.to_date(F.timestamp_seconds(F.col("hour_idx") * 3600))
    return r.groupBy(key, day.alias("date")).agg(F.max("avg8h").alias("max_8h_mean"))


def ewm_means(df: DataFrame, value: str, spans: list[int], key: str = "city_name", date: str = "date") -> DataFrame:
    """Exponentially weighted means (adjust=True, NULLs skipped but counted in the decay), one column
    ``{value}_ewm{span}`` for each span: sum(q^(t-j) x_j) / sum(q^(t-j)) over all present x_j up to t,
    q = 1 - 2/(span+1).  Numerator and denominator are carried forward in date order, so a gap of any
    length keeps the last value.  One city's days, bounded by the calendar, are one group."""
    import pandas as pd

    names = [f"{value}_ewm{s}" for s in spans]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable")
        x = pdf[value].astype("float64")
        return pdf.assign(**{n: x.ewm(span=s, adjust=True, ignore_na=False).mean() for n, s in zip(names, spans)})

    schema = df.select("*", *[F.lit(0.0).alias(n) for n in names]).schema
    for n in names:
        schema[n].nullable = True
    return df.groupBy(key).applyInPandas(run, schema)
