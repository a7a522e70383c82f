"""Output normalisation shared by every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


# The rounding point sits a hair (1.23456e-8) below the decimal tie so values
# that are exact ties in decimal (common for averages of 2-dp inputs) do not
# straddle it by one ulp depending on the engine's summation order.
ROUND_NUDGE = 0.000123456


def round4(c):
    """Round at 4 dp with plain IEEE steps (identical in every engine); stays a double at any size."""
    return F.rint(c * F.lit(10000.0) + F.lit(ROUND_NUDGE)) / F.lit(10000.0)


def finish(df: DataFrame) -> DataFrame:
    """Round every double column to 4 dp; NaN never leaves a query (it becomes NULL)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.col(f"`{f.name}`")
            c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
            cols.append(round4(c).cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
