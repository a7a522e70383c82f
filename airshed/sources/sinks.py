"""Sinks: partitioned city/year tables, finalised air table, reports, result tables.

Writes go to the shared folder named by ``spark.checkpoint.dir`` unless a path
is given; every write is ``overwrite`` with dynamic partition overwrite, so a
re-run replaces exactly the partitions it produces (idempotent).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from airshed.functions.units import snap
from airshed.session import checkpoint_dir

KEEP_EXACT = ("station_count", "data_quality_score")


def round2(c: Column) -> Column:
    """Half-to-even at 2 dp on the binary value (scaled rint), like NumPy's round; the value is
    first snapped to 1e-9 so the result does not depend on summation order."""
    return F.rint(snap(c) * F.lit(100.0)) / F.lit(100.0)


def format_numeric(df: DataFrame, exclude_suffixes=("_id", "_count", "_is_outlier", "_interpolated")) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)) and not f.name.endswith(exclude_suffixes) \
                and f.name not in KEEP_EXACT:
            cols.append(round2(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def default_path(df: DataFrame, name: str) -> str:
    return os.path.join(checkpoint_dir(df.sparkSession), "sinks", f"{name}-{uuid.uuid4().hex[:8]}")


def write_city_year(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Per-city per-year files (one table partitioned by city and year); numerics rounded to 2 dp."""
    out = format_numeric(df)
    out = out.withColumn("city_part", F.translate(F.col("city_name"), " /", "__"))
    # one file per city-year instead of one per (task, city-year)
    w = out.repartition("city_part", "year").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("city_part", "year")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def finalize_air(df: DataFrame) -> DataFrame:
    """Drop unit columns, round floats to 2 dp, integral counts as long, quality score clipped to [0, 1]."""
    keep = [c for c in df.columns if not c.endswith("_unit")]
    cols = []
    for f in df.select(*keep).schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "data_quality_score":
            cols.append(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias(f.name))
        elif f.name.endswith("_source_count") or f.name == "station_count":
            cols.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round2(c).alias(f.name))
        elif isinstance(f.dataType, (IntegerType, LongType)):
            cols.append(c.cast("long").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def quality_report(df: DataFrame, cols: list[str], date: str = "date") -> DataFrame:
    """Per column: non-NULL count, coverage %, mean, min, max; plus the table's date range.
    One aggregate for all columns, reshaped to long form."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n"), F.min(date).alias("start_date"), F.max(date).alias("end_date")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"), F.min(c).alias(f"{c}|min"),
                 F.max(c).alias(f"{c}|max")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}|count`").cast("long").alias("count"),
                                        (F.col(f"`{c}|count`") * F.lit(100.0) / F.col("_n")).alias("coverage_pct"),
                                        F.col(f"`{c}|mean`").alias("mean"), F.col(f"`{c}|min`").alias("min"),
                                        F.col(f"`{c}|max`").alias("max")) for c in cols]))
    return one.select("start_date", "end_date", rows.alias("r")).select("r.*", "start_date", "end_date")


def write_results(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Results table / leaderboard sink (JSON lines or Parquet)."""
    w = df.write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.parquet(path))
    return path
