"""Chronological splits without a global single-partition window.

The position of a row in date order is computed from per-date counts (one row
per distinct date, a bounded table) with a running sum, joined back, plus the
row's rank inside its date (ties broken by city).  No operator here orders the
whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airshed.constants import CV_SPLITS, TEST_SIZE, VAL_SIZE


def positions(df: DataFrame, date: str = "date", tie: str = "city_name") -> DataFrame:
    """Adds ``_pos`` (0-based rank in (date, tie) order) and ``_n`` (row count)."""
    per_date = df.groupBy(date).agg(F.count("*").alias("_cnt"))
    # running totals over the per-date table (bounded by the number of distinct days)
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_date.select(date, F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_before"),
                              F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    inner = Window.partitionBy(date).orderBy(tie)
    ranked = df.select("*", (F.row_number().over(inner) - 1).alias("_in_date"))
    return ranked.join(F.broadcast(offsets), date).select(
        *df.columns, (F.col("_before") + F.col("_in_date")).alias("_pos"), F.col("_n"))


def split_bounds(test_size: float = TEST_SIZE, val_size: float = VAL_SIZE):
    return 1 - test_size, 1 - val_size / (1 - test_size)


def chrono_split(df: DataFrame, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                 date: str = "date", tie: str = "city_name") -> DataFrame:
    """70/15/15 by position: test starts at int(n(1-test)), val at int(t(1-val/(1-test)))."""
    c_test, c_val = split_bounds(test_size, val_size)
    p = positions(df, date, tie)
    t_idx = F.floor(F.col("_n") * F.lit(c_test))
    v_idx = F.floor(t_idx * F.lit(c_val))
    role = F.when(F.col("_pos") < v_idx, "train").when(F.col("_pos") < t_idx, "val").otherwise("test")
    return p.select(*df.columns, role.alias("split"))


def ts_cv_folds(df: DataFrame, n_splits: int = CV_SPLITS, date: str = "date", tie: str = "city_name") -> DataFrame:
    """Expanding-window folds: test size n // (k+1); per (fold, role) the row count and date span."""
    p = positions(df, date, tie)
    size = F.floor(F.col("_n") / F.lit(n_splits + 1))
    rows = []
    for i in range(n_splits):
        train_end = F.col("_n") - F.lit(n_splits - i) * size
        role = F.when(F.col("_pos") < train_end, "train").when(F.col("_pos") < train_end + size, "test")
        rows.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    exploded = p.select(date, F.explode(F.array(*rows)).alias("f")).where(F.col("f.role").isNotNull())
    return exploded.groupBy(F.col("f.fold").alias("fold"), F.col("f.role").alias("role")).agg(
        F.count("*").cast("long").alias("n_rows"), F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def temporal_split(df: DataFrame, train_end: str | None = None, val_end: str | None = None,
                   date: str = "date", tie: str = "city_name") -> DataFrame:
    """Date-bound split; without bounds 70 % train, then half of the rest each."""
    if train_end and val_end:
        d = F.col(date)
        role = F.when(d < F.lit(train_end).cast("date"), "train") \
            .when(d < F.lit(val_end).cast("date"), "val").otherwise("test")
        return df.select("*", role.alias("split"))
    p = positions(df, date, tie)
    s = F.floor(F.col("_n") * F.lit(0.7))
    rest = F.col("_n") - s
    v = s + F.floor(rest * F.lit(0.5))
    role = F.when(F.col("_pos") < s, "train").when(F.col("_pos") < v, "val").otherwise("test")
    return p.select(*df.columns, role.alias("split"))


def eligible_cities(df: DataFrame, target: str = "pm25", min_rows: int = 100, min_target: int = 100,
                    key: str = "city_name") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").cast("long").alias("n_rows"),
                               F.count(target).cast("long").alias("n_target")) \
        .where((F.col("n_rows") >= min_rows) & (F.col("n_target") >= min_target))
