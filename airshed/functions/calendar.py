"""Calendar features (weekday 0 = Monday; season = month % 12 // 3)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(date: Column) -> list[Column]:
    doy = F.dayofyear(date)
    month = F.month(date)
    dow = F.weekday(date)
    two_pi = 2 * math.pi
    return [
        doy.cast("int").alias("day_of_year"),
        F.sin(F.lit(two_pi) * doy / F.lit(365.0)).alias("day_sin"),
        F.cos(F.lit(two_pi) * doy / F.lit(365.0)).alias("day_cos"),
        month.cast("int").alias("month"),
        F.sin(F.lit(two_pi) * month / F.lit(12.0)).alias("month_sin"),
        F.cos(F.lit(two_pi) * month / F.lit(12.0)).alias("month_cos"),
        dow.cast("int").alias("day_of_week"),
        dow.isin(5, 6).cast("int").alias("is_weekend"),
        F.floor((month % 12) / 3).cast("int").alias("season"),
        F.quarter(date).cast("int").alias("quarter"),
    ]


def period_flag_columns(date: Column) -> list[Column]:
    month = F.month(date)
    dow = F.weekday(date)
    return [
        month.isin(11, 12, 1, 2, 3).cast("int").alias("is_heating"),
        month.isin(6, 7, 8).cast("int").alias("is_ozone_season"),
        month.isin(3, 4).cast("int").alias("is_dust_season"),
        (dow == 0).cast("int").alias("is_monday"),
        (dow == 4).cast("int").alias("is_friday"),
        month.isin(11, 12, 1, 2).cast("int").alias("is_winter"),
        month.isin(6, 7, 8).cast("int").alias("is_summer_ozone"),
    ]
