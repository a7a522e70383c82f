"""Registered queries: exploratory statistics, metrics, leaderboard."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from airshed.constants import POLLUTANTS, POLLUTION_LEVELS, WEATHER_COLS
from airshed.operators import eda as E
from airshed.operators import features as FE
from airshed.plans.oracle_views import with_views as V
from airshed.plans.pipeline import CityPipeline, stored_merged
from airshed.plans.registry import query
from airshed.plans.sqlgen import dlit
from airshed.plans.sqlgen import snap_sql as S
from airshed.sources import domain

VARS = [*POLLUTANTS, *WEATHER_COLS]


def merged(spark, d):
    """The stored merged city-day table (written once by the ETL, then scanned)."""
    return stored_merged(spark, d)


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@query("missing_stats", V("merged") + _union(
    [f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, "
     f"(count(*) - count({c})) * 100e0 / count(*) AS pct_missing FROM merged" for c in WEATHER_COLS + POLLUTANTS]),
       ["pct_missing"])
def missing_stats(spark, d):
    """Missing count and percentage per column."""
    return E.missing_stats(merged(spark, d), WEATHER_COLS + POLLUTANTS)


@query("missing_by_city", V("merged") + "SELECT city_name, " + ", ".join(
    f"avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100e0 AS {c}_missing_pct" for c in VARS) +
       " FROM merged GROUP BY city_name", [f"{c}_missing_pct" for c in VARS])
def missing_by_city(spark, d):
    """Missing % per city x variable."""
    return merged(spark, d).groupBy("city_name").agg(
        *[(F.avg(F.col(c).isNull().cast("double")) * F.lit(100.0)).alias(f"{c}_missing_pct") for c in VARS])


_DESC = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("describe", V("merged") + _union(
    [f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
     f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, "
     f"max({c}) AS max FROM merged" for c in VARS]), _DESC)
def describe(spark, d):
    """describe(): count, mean, std, min, exact quartiles, max."""
    return E.describe(merged(spark, d), VARS)


@query("pollutant_summary", V("merged") + _union(
    [f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
     f"median({c}) AS median, skewness({c}) AS skew, (count(*) - count({c})) * 100e0 / count(*) AS missing_pct "
     f"FROM merged" for c in POLLUTANTS]), ["mean", "std", "median", "skew", "missing_pct"])
def pollutant_summary(spark, d):
    """Per pollutant summary incl. bias-corrected skewness and missing %."""
    m = merged(spark, d).select(*POLLUTANTS)
    lf = E.long_form(m, [], POLLUTANTS)
    median = E.exact_quantiles(lf, "variable", "value", [0.5]).select("variable", F.col("q")[0].alias("median"))
    moments = lf.groupBy("variable").agg(
        F.count("value").cast("long").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        E.skewness_unbiased(F.col("value")).alias("skew"),
        ((F.count("*") - F.count("value")) * F.lit(100.0) / F.count("*")).alias("missing_pct"))
    return moments.join(median, "variable").select("variable", "count", "mean", "std", "median", "skew", "missing_pct")


@query("city_stats", V("merged") + """
SELECT *, CAST(row_number() OVER (ORDER BY mean DESC, city_name) AS INTEGER) AS rank FROM (
  SELECT city_name, avg(pm25) AS mean, stddev_samp(pm25) AS std, median(pm25) AS median, count(pm25) AS count
  FROM merged GROUP BY city_name) s""", ["mean", "std", "median"])
def city_stats(spark, d):
    """Per-city mean / std / median / count of PM2.5, ranked by mean."""
    s = merged(spark, d).groupBy("city_name").agg(
        F.avg("pm25").alias("mean"), F.stddev_samp("pm25").alias("std"), F.percentile("pm25", 0.5).alias("median"),
        F.count("pm25").cast("long").alias("count"))
    # ranking over one row per city (bounded by the number of cities)
    return s.select("*", F.row_number().over(Window.orderBy(F.col("mean").desc(), "city_name")).alias("rank"))


@query("city_cv", V("merged") + "SELECT city_name, stddev_samp(pm25) / avg(pm25) AS cv FROM merged GROUP BY city_name",
       ["cv"])
def city_cv(spark, d):
    """Coefficient of variation per city."""
    return merged(spark, d).groupBy("city_name").agg((F.stddev_samp("pm25") / F.avg("pm25")).alias("cv"))


@query("skew_compare", V("merged") + _union(
    [f"SELECT '{c}' AS variable, skewness({c}) AS skew_raw, "
     f"CASE WHEN min({c}) >= 0 THEN skewness(ln(1e0 + {c})) END AS skew_log1p, "
     f"CASE WHEN min({c}) >= 0 THEN (abs(skewness({c})) - abs(skewness(ln(1e0 + {c})))) / abs(skewness({c})) * 100e0 "
     f"END AS improvement_pct FROM merged" for c in POLLUTANTS]), ["skew_raw", "skew_log1p", "improvement_pct"])
def skew_compare(spark, d):
    """Skewness before / after log1p (only when all values >= 0), improvement %."""
    lf = E.long_form(merged(spark, d).select(*POLLUTANTS), [], POLLUTANTS)
    raw = E.skewness_unbiased(F.col("value"))
    lg = E.skewness_unbiased(F.log1p("value"))
    ok = F.min("value") >= 0
    return lf.groupBy("variable").agg(
        raw.alias("skew_raw"), F.when(ok, lg).alias("skew_log1p"),
        F.when(ok, (F.abs(raw) - F.abs(lg)) / F.abs(raw) * F.lit(100.0)).alias("improvement_pct"))


@query("monthly_means", V("merged") + "SELECT CAST(month(date) AS INTEGER) AS month, avg(pm25) AS pm25_mean, "
       "avg(temp_avg_c) AS temp_mean FROM merged GROUP BY month(date)", ["pm25_mean", "temp_mean"])
def monthly_means(spark, d):
    """Month means."""
    return merged(spark, d).groupBy(F.month("date").cast("int").alias("month")).agg(
        F.avg("pm25").alias("pm25_mean"), F.avg("temp_avg_c").alias("temp_mean"))


_M = [str(m) for m in range(1, 13)]


@query("city_month_pivot", V("merged") + "SELECT city_name, " + ", ".join(
    f"avg(CASE WHEN month(date) = {m} THEN pm25 END) AS \"{m}\"" for m in _M) + " FROM merged GROUP BY city_name", _M)
def city_month_pivot(spark, d):
    """City x month mean PM2.5 pivot (values listed, one shuffle)."""
    m = merged(spark, d).select("city_name", F.month("date").cast("string").alias("month"), "pm25")
    return m.groupBy("city_name").pivot("month", _M).agg(F.avg("pm25"))


_DOW = [str(i) for i in range(7)]


@query("city_dow_pivot", V("merged") + "SELECT city_name, " + ", ".join(
    f"avg(CASE WHEN isodow(date) - 1 = {i} THEN pm25 END) AS \"{i}\"" for i in _DOW) + " FROM merged GROUP BY city_name",
       _DOW)
def city_dow_pivot(spark, d):
    """City x weekday (0 = Monday) mean PM2.5 pivot."""
    m = merged(spark, d).select("city_name", F.weekday("date").cast("string").alias("dow"), "pm25")
    return m.groupBy("city_name").pivot("dow", _DOW).agg(F.avg("pm25"))


@query("counts_city_year", V("merged") + "SELECT city_name, year, count(*) AS n FROM merged GROUP BY city_name, year")
def counts_city_year(spark, d):
    """Record counts by city and year."""
    return merged(spark, d).groupBy("city_name", "year").agg(F.count("*").cast("long").alias("n"))


_PAIRS = [(a, b) for i, a in enumerate(VARS) for b in VARS[i + 1:]]


@query("corr_pearson", V("merged") + _union(
    [f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count({a} + {b}) AS n FROM merged" for a, b in _PAIRS]),
       ["r"])
def corr_pearson(spark, d):
    """The Pearson matrix of all measures, pairwise complete (one aggregate for all pairs)."""
    return E.corr_matrix(merged(spark, d), _PAIRS)


@query("corr_by_city", V("merged") + "SELECT city_name, " + ", ".join(
    f"corr(pm25, {c}) AS r_{c}" for c in WEATHER_COLS) + " FROM merged GROUP BY city_name",
       [f"r_{c}" for c in WEATHER_COLS])
def corr_by_city(spark, d):
    """Per-city correlation of PM2.5 with each weather variable."""
    return merged(spark, d).groupBy("city_name").agg(*[F.corr("pm25", c).alias(f"r_{c}") for c in WEATHER_COLS])


@query("corr_pairs_strong", V("merged") + "SELECT * FROM (" + _union(
    [f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM merged" for a, b in _PAIRS]) +
       ") x WHERE abs(r) > 0.3e0", ["r"])
def corr_pairs_strong(spark, d):
    """Pairs with |r| > 0.3."""
    return E.corr_matrix(merged(spark, d), _PAIRS).select("var1", "var2", "r").where(F.abs("r") > F.lit(0.3))


@query("corr_listwise", V("merged", extra=[("full_rows", "SELECT * FROM merged WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in VARS))]) + _union(
    [f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count(*) AS n FROM full_rows" for a, b in _PAIRS]),
       ["r"])
def corr_listwise(spark, d):
    """The same matrix over rows where every measure is present (listwise)."""
    return E.corr_matrix(merged(spark, d).na.drop(subset=VARS), _PAIRS)


@query("topk_corr", V("merged") + "SELECT *, CAST(row_number() OVER (ORDER BY round(abs(r) * 1e9) DESC, var1, var2) AS INTEGER) AS rank FROM (" + _union(
    [f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM merged" for a, b in _PAIRS]) +
       ") x WHERE r IS NOT NULL QUALIFY rank <= 10", ["r"])
def topk_corr(spark, d):
    """The ten pairs of measures with the largest |r| (a top-k report)."""
    m = E.corr_matrix(merged(spark, d), _PAIRS).where(F.col("r").isNotNull()).select("var1", "var2", "r")
    w = Window.orderBy(F.rint(F.abs("r") * F.lit(1e9)).desc(), "var1", "var2")  # 91 rows
    return m.select("*", F.row_number().over(w).cast("int").alias("rank")).where("rank <= 10")


@query("boxplot_by_month", V("merged", extra=[("q", """
  SELECT month(date) AS month, quantile_cont(pm25, 0.25) AS q1, quantile_cont(pm25, 0.5) AS median,
         quantile_cont(pm25, 0.75) AS q3 FROM merged WHERE pm25 IS NOT NULL GROUP BY 1""")]) + """
SELECT CAST(q.month AS INTEGER) AS month, q1, median, q3, q3 - q1 AS iqr,
  min(CASE WHEN pm25 >= q1 - 1.5e0 * (q3 - q1) AND pm25 <= q3 + 1.5e0 * (q3 - q1) THEN pm25 END) AS whisker_low,
  max(CASE WHEN pm25 >= q1 - 1.5e0 * (q3 - q1) AND pm25 <= q3 + 1.5e0 * (q3 - q1) THEN pm25 END) AS whisker_high,
  CAST(sum(CASE WHEN pm25 >= q1 - 1.5e0 * (q3 - q1) AND pm25 <= q3 + 1.5e0 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM merged m JOIN q ON month(m.date) = q.month WHERE pm25 IS NOT NULL
GROUP BY q.month, q1, median, q3""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"])
def boxplot_by_month(spark, d):
    """Box-plot statistics per month."""
    return E.boxplot_stats(merged(spark, d).select(F.month("date").alias("month"), "pm25"), "month", "pm25")


@query("series_slice", V("merged") + """
SELECT city_name, date, pm25, temp_avg_c FROM merged WHERE year = 1999 AND pm25 IS NOT NULL AND temp_avg_c IS NOT NULL
  AND city_name IN (SELECT city_name FROM merged WHERE year = 1999 AND pm25 IS NOT NULL AND temp_avg_c IS NOT NULL
                    GROUP BY city_name ORDER BY count(*) DESC, city_name LIMIT 3)""", ["pm25", "temp_avg_c"])
def series_slice(spark, d):
    """One year's series of the three cities with the most days that have both variables."""
    m = merged(spark, d).where((F.col("year") == 1999) & F.col("pm25").isNotNull() & F.col("temp_avg_c").isNotNull())
    top = m.groupBy("city_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "city_name").limit(3)
    return m.join(top, "city_name", "left_semi").select("city_name", "date", "pm25", "temp_avg_c")


_SP = _PAIRS


def _spearman_sql(a, b):
    return (f"SELECT '{a}' AS var1, '{b}' AS var2, corr(ra, rb) AS rho, count(*) AS n, "
            f"CASE WHEN abs(corr(ra, rb)) > 0.5 THEN 'strong' WHEN abs(corr(ra, rb)) > 0.3 THEN 'moderate' "
            f"ELSE 'weak' END AS strength FROM ("
            f"SELECT rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2e0 AS ra, "
            f"rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2e0 AS rb "
            f"FROM (SELECT {S(a)} AS sa, {S(b)} AS sb FROM merged WHERE {a} IS NOT NULL AND {b} IS NOT NULL) s) t")


@query("corr_spearman", V("merged") + _union([_spearman_sql(a, b) for a, b in _SP]), ["rho"])
def corr_spearman(spark, d):
    """Spearman rho (pairwise complete, average ranks for ties) with strength labels.
    Ranks are range-bucketed (no global single-partition sort)."""
    r = E.spearman_pairs(merged(spark, d), _SP)
    return r.select("var1", "var2", "rho", "n", E.strength(F.col("rho")).alias("strength"))


_LAGS = list(range(1, 8))


@query("autocorr", V("merged") + _union(
    [f"SELECT city_name, {k} AS lag, corr(pm25, l) AS r FROM (SELECT city_name, pm25, lag(pm25, {k}) OVER "
     f"(PARTITION BY city_name ORDER BY date) AS l FROM merged) t GROUP BY city_name" for k in _LAGS]), ["r"])
def autocorr(spark, d):
    """Lag-k autocorrelation per city (Pearson of the series with its shift)."""
    m = merged(spark, d).select("city_name", "date", "pm25")
    w = Window.partitionBy("city_name").orderBy("date")
    lagged = m.select("city_name", "pm25", *[F.lag("pm25", k).over(w).alias(f"l{k}") for k in _LAGS])
    one = lagged.groupBy("city_name").agg(*[F.corr("pm25", f"l{k}").alias(f"r{k}") for k in _LAGS])
    return one.select("city_name", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r"))
                                                       for k in _LAGS])).alias("s")).select("city_name", "s.lag", "s.r")


ACF_LAGS = 30


def acf_frame(spark, d):
    m = merged(spark, d).where(F.col("pm25").isNotNull()).select("city_name", "date", "pm25")
    w = Window.partitionBy("city_name").orderBy("date")
    mean = F.avg("pm25").over(Window.partitionBy("city_name"))
    c = m.select("city_name", "date", (F.col("pm25") - mean).alias("x"))
    lagged = c.select("city_name", "x", *[F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, ACF_LAGS + 1)])
    one = lagged.groupBy("city_name").agg(F.sum(F.col("x") * F.col("x")).alias("_den"),
                                          *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"n{k}")
                                            for k in range(1, ACF_LAGS + 1)])
    arr = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")),
                  *[F.struct(F.lit(k).alias("lag"), (F.col(f"n{k}") / F.col("_den")).alias("acf"))
                    for k in range(1, ACF_LAGS + 1)])
    return one.select("city_name", F.explode(arr).alias("s")).select("city_name", "s.lag", "s.acf")


_ACF_VIEW = ("c", "SELECT city_name, date, pm25 - avg(pm25) OVER (PARTITION BY city_name) AS x FROM merged WHERE pm25 IS NOT NULL")
_ACF_SQL = "SELECT city_name, 0 AS lag, 1e0 AS acf FROM c GROUP BY city_name UNION ALL " + _union(
    [f"SELECT city_name, {k} AS lag, sum(x * l) / sum(x * x) AS acf FROM (SELECT city_name, x, lag(x, {k}) OVER "
     f"(PARTITION BY city_name ORDER BY date) AS l FROM c) t GROUP BY city_name" for k in range(1, ACF_LAGS + 1)])


@query("acf", V("merged", extra=[_ACF_VIEW]) + _ACF_SQL, ["acf"])
def acf(spark, d):
    """ACF lags 0..30 per city (global mean, total-variance denominator)."""
    return acf_frame(spark, d)


# Durbin-Levinson: phi holds the coefficients of order k, r the autocorrelations of lags 1, 2, ...
_DL = f"""
SELECT city_name, lag, pacf FROM (
  WITH RECURSIVE dl AS (
    SELECT city_name, r, 1 AS k, [r[1]] AS phi, r[1] AS pacf FROM rs
    UNION ALL
    SELECT city_name, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - p * phi[k + 1 - j]), p), p FROM (
      SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
                / (1e0 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS p
      FROM dl WHERE k < {ACF_LAGS}) t
  )
  SELECT city_name, k AS lag, pacf FROM dl UNION ALL SELECT city_name, 0 AS lag, 1e0 AS pacf FROM rs) o"""


@query("pacf", V("merged", extra=[_ACF_VIEW, ("a", _ACF_SQL),
                                  ("rs", "SELECT city_name, list(acf ORDER BY lag) AS r FROM a WHERE lag > 0 GROUP BY city_name")]) + _DL, ["pacf"])
def pacf(spark, d):
    """PACF lags 0..30 per city by Durbin-Levinson over the ACF rows (31 rows per city,
    solved in ``applyInPandas``; the heavy part -- the ACF sums -- stays in Spark)."""
    import pandas as pd

    def durbin_levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(dtype=float)
        n = len(r) - 1
        out = np.full(n + 1, np.nan)
        out[0] = 1.0
        phi = np.zeros((n + 1, n + 1))
        if n >= 1:
            phi[1, 1] = r[1]
            out[1] = r[1]
        for k in range(2, n + 1):
            num = r[k] - np.dot(phi[k - 1, 1:k], r[1:k][::-1])
            den = 1.0 - np.dot(phi[k - 1, 1:k], r[1:k])
            phi[k, k] = num / den if den != 0 else np.nan
            for j in range(1, k):
                phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
            out[k] = phi[k, k]
        return pd.DataFrame({"city_name": pdf["city_name"].iloc[0], "lag": pdf["lag"].to_numpy(), "pacf": out})

    return acf_frame(spark, d).groupBy("city_name").applyInPandas(
        durbin_levinson, "city_name string, lag int, pacf double")


@query("histogram", V("merged", extra=[("mm", "SELECT min(pm25) AS mn, max(pm25) AS mx FROM merged")]) + """
SELECT bin, mn + bin * (mx - mn) / 50e0 AS lo, mn + (bin + 1) * (mx - mn) / 50e0 AS hi, count(*) AS count FROM (
  SELECT CAST(least(floor((pm25 - mn) / (mx - mn) * 50e0), 49) AS INTEGER) AS bin, mn, mx
  FROM merged, mm WHERE pm25 IS NOT NULL) t GROUP BY bin, mn, mx""", ["lo", "hi"])
def histogram(spark, d):
    """50 equal-width bins of PM2.5 (last bin closed)."""
    return E.histogram(merged(spark, d), "pm25", 50)


@query("boxplot_stats", V("merged", extra=[("q", """
  SELECT city_name, quantile_cont(pm25, 0.25) AS q1, quantile_cont(pm25, 0.5) AS median,
         quantile_cont(pm25, 0.75) AS q3 FROM merged WHERE pm25 IS NOT NULL GROUP BY city_name""")]) + """
SELECT q.city_name, q1, median, q3, q3 - q1 AS iqr,
  min(CASE WHEN pm25 >= q1 - 1.5e0 * (q3 - q1) AND pm25 <= q3 + 1.5e0 * (q3 - q1) THEN pm25 END) AS whisker_low,
  max(CASE WHEN pm25 >= q1 - 1.5e0 * (q3 - q1) AND pm25 <= q3 + 1.5e0 * (q3 - q1) THEN pm25 END) AS whisker_high,
  CAST(sum(CASE WHEN pm25 >= q1 - 1.5e0 * (q3 - q1) AND pm25 <= q3 + 1.5e0 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM merged m JOIN q ON m.city_name = q.city_name WHERE pm25 IS NOT NULL
GROUP BY q.city_name, q1, median, q3""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"])
def boxplot_stats(spark, d):
    """Box-plot statistics per city (quartiles, 1.5 IQR whiskers, outlier count)."""
    return E.boxplot_stats(merged(spark, d), "city_name", "pm25")


def _level_sql(c):
    s = S(c)
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {s} > 35e0 THEN 'high' WHEN {s} >= 15e0 THEN 'medium' "
            f"WHEN {s} >= 10e0 THEN 'low' ELSE 'clean' END")


@query("pollution_levels", V("merged") + f"""
SELECT city_name, level, count(*) AS n, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY city_name) AS share
FROM (SELECT city_name, {_level_sql('pm25')} AS level FROM merged WHERE pm25 IS NOT NULL) t
GROUP BY city_name, level""", ["share"])
def pollution_levels(spark, d):
    """Share of days per pollution level (>35, 15-35, 10-15, <10) per city."""
    m = merged(spark, d).where(F.col("pm25").isNotNull())
    g = m.groupBy("city_name", E.level_of(F.col("pm25"), POLLUTION_LEVELS).alias("level")).agg(
        F.count("*").cast("long").alias("n"))
    return g.select("*", (F.col("n") * F.lit(1.0) / F.sum("n").over(Window.partitionBy("city_name"))).alias("share"))


def _vis_bin_sql(c):
    s = S(c)
    return (f"CASE WHEN {s} < 5e0 THEN '<5' WHEN {s} < 10e0 THEN '5-10' WHEN {s} < 15e0 THEN '10-15' "
            f"WHEN {s} < 20e0 THEN '15-20' ELSE '>20' END")


@query("pm25_by_visibility", V("merged") + f"""
SELECT {_vis_bin_sql('visibility_km')} AS visibility_bin, median(pm25) AS pm25_median, count(*) AS n
FROM merged WHERE visibility_km IS NOT NULL AND pm25 IS NOT NULL GROUP BY 1""", ["pm25_median"])
def pm25_by_visibility(spark, d):
    """Median PM2.5 per visibility bin."""
    from airshed.functions.units import snap
    m = merged(spark, d).where(F.col("visibility_km").isNotNull() & F.col("pm25").isNotNull())
    v = snap(F.col("visibility_km"))
    b = F.when(v < 5, "<5").when(v < 10, "5-10").when(v < 15, "10-15").when(v < 20, "15-20").otherwise(">20")
    m = m.select(b.alias("visibility_bin"), "pm25")
    n = m.groupBy("visibility_bin").agg(F.count("*").cast("long").alias("n"))
    return n.join(E.exact_quantiles(m, "visibility_bin", "pm25", [0.5]), "visibility_bin").select(
        "visibility_bin", F.col("q")[0].alias("pm25_median"), "n")


@query("validate_data", V("merged") + """
SELECT count(*) AS total_rows, (count(*) - count(pm25)) * 100e0 / count(*) AS pm25_missing_pct,
  min(date) AS min_date, max(date) AS max_date, CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS span_days,
  count(CASE WHEN pm25 > 1000e0 THEN 1 END) AS n_outliers,
  (count(*) - count(pm25)) * 100e0 / count(*) < 20e0 AS missing_ok FROM merged""", ["pm25_missing_pct"])
def validate_data(spark, d):
    """Validation report row (missing < 20 %, outliers > 1000)."""
    m = merged(spark, d)
    miss = (F.count("*") - F.count("pm25")) * F.lit(100.0) / F.count("*")
    return m.agg(F.count("*").cast("long").alias("total_rows"), miss.alias("pm25_missing_pct"),
                 F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                 F.datediff(F.max("date"), F.min("date")).alias("span_days"),
                 F.count(F.when(F.col("pm25") > 1000, 1)).cast("long").alias("n_outliers"),
                 (miss < 20).alias("missing_ok"))


@query("city_acceptance", V("merged") + """
SELECT a.city_name, missing_pct, max_gap_days, min_days_per_month, n_years,
  missing_pct <= 30e0 AND max_gap_days <= 7 AND min_days_per_month >= 20 AND n_years >= 2 AS accepted
FROM (SELECT city_name, (count(*) - count(pm25)) * 100e0 / count(*) AS missing_pct,
             count(DISTINCT year) AS n_years FROM merged GROUP BY city_name) a
JOIN (SELECT city_name, CAST(max(gap) AS INTEGER) AS max_gap_days FROM (
        SELECT city_name, date_diff('day', lag(date) OVER (PARTITION BY city_name ORDER BY date), date) AS gap
        FROM merged) g GROUP BY city_name) b ON a.city_name = b.city_name
JOIN (SELECT city_name, min(n) AS min_days_per_month FROM (
        SELECT city_name, year, month(date) AS m, count(*) AS n FROM merged GROUP BY city_name, year, month(date)) x
      GROUP BY city_name) c ON a.city_name = c.city_name""", ["missing_pct"])
def city_acceptance(spark, d):
    """City acceptance (missing <= 30 %, no gap > 7 days, >= 20 days per month, >= 2 years)."""
    m = merged(spark, d)
    w = Window.partitionBy("city_name").orderBy("date")
    gaps = m.select("city_name", F.datediff("date", F.lag("date").over(w)).alias("gap")) \
        .groupBy("city_name").agg(F.max("gap").alias("max_gap_days"))
    months = m.groupBy("city_name", "year", F.month("date").alias("m")).agg(F.count("*").alias("n")) \
        .groupBy("city_name").agg(F.min("n").cast("long").alias("min_days_per_month"))
    base = m.groupBy("city_name").agg(
        ((F.count("*") - F.count("pm25")) * F.lit(100.0) / F.count("*")).alias("missing_pct"),
        F.count_distinct("year").cast("long").alias("n_years"))
    j = base.join(gaps, "city_name").join(months, "city_name")
    ok = (F.col("missing_pct") <= 30) & (F.col("max_gap_days") <= 7) & (F.col("min_days_per_month") >= 20) \
        & (F.col("n_years") >= 2)
    return j.select("city_name", "missing_pct", "max_gap_days", "min_days_per_month", "n_years", ok.alias("accepted"))


_Q = [0.02, 0.25, 0.5, 0.75, 0.98]
_QN = ["q02", "q25", "median", "q75", "q98"]


@query("daily_sensor_summary", V("air_parsed") + "SELECT location_id, parameter, date, min(value) AS min, " + ", ".join(
    f"quantile_cont(value, {q}) AS {n}" for q, n in zip(_Q, _QN)) + """, max(value) AS max, avg(value) AS avg,
  stddev_samp(value) AS sd, 24 AS expected_count, count(value) AS observed_count,
  count(value) * 100e0 / 24e0 AS percent_complete
FROM air_parsed WHERE value IS NOT NULL GROUP BY location_id, parameter, date""",
       ["min", *_QN, "max", "avg", "sd", "percent_complete"])
def daily_sensor_summary(spark, d):
    """Daily per-sensor summary (min, q02, q25, median, q75, q98, max, avg, sd) and coverage."""
    p = CityPipeline(spark, d).air_parsed().where(F.col("value").isNotNull())
    p = p.select(F.struct("location_id", "parameter", "date").alias("sensor_day"), "value")
    g = E.group_quantiles(p, "sensor_day", "value", _Q, also=[
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.stddev_samp("value").alias("sd"),
        F.count("value").cast("long").alias("observed_count")])
    return g.select("sensor_day.*", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(_QN)],
                    "max", "avg", "sd", F.lit(24).alias("expected_count"), "observed_count",
                    (F.col("observed_count") * F.lit(100.0) / F.lit(24.0)).alias("percent_complete"))


@query("city_fingerprint", V("merged", "city", extra=[("t", """
  SELECT m.* FROM merged m JOIN (SELECT city_name, max(date) AS last FROM merged GROUP BY city_name) l
    ON m.city_name = l.city_name WHERE m.date > l.last - INTERVAL 365 DAY""")]) + """
SELECT a.city_name, mean_1y, median_1y, p95_1y, seasonal_var, ln(c.population) AS log_population FROM (
  SELECT city_name, avg(pm25) AS mean_1y, quantile_cont(pm25, 0.5) AS median_1y, quantile_cont(pm25, 0.95) AS p95_1y
  FROM t GROUP BY city_name) a
JOIN (SELECT city_name, var_samp(sm) AS seasonal_var FROM (
        SELECT city_name, floor((month(date) % 12) / 3) AS season, avg(pm25) AS sm FROM merged
        GROUP BY city_name, floor((month(date) % 12) / 3)) s GROUP BY city_name) b ON a.city_name = b.city_name
JOIN (SELECT replace(city_name, '_', ' ') AS city_name, population FROM city) c ON a.city_name = c.city_name""",
       ["mean_1y", "median_1y", "p95_1y", "seasonal_var", "log_population"])
def city_fingerprint(spark, d):
    """Trailing-year mean / median / p95, variance of season means, log population."""
    from airshed.operators.merge import normalise_city_name
    m = merged(spark, d)
    last = m.groupBy("city_name").agg(F.max("date").alias("_last"))
    t = m.join(last, "city_name").where(F.col("date") > F.date_sub("_last", 365))
    a = t.groupBy("city_name").agg(F.avg("pm25").alias("mean_1y"),
                                   F.percentile("pm25", F.array(F.lit(0.5), F.lit(0.95))).alias("_q"))
    s = m.groupBy("city_name", F.floor((F.month("date") % 12) / 3).alias("season")).agg(F.avg("pm25").alias("sm")) \
        .groupBy("city_name").agg(F.var_samp("sm").alias("seasonal_var"))
    c = domain.cities(spark, d).select(normalise_city_name(F.col("city_name")).alias("city_name"), "population")
    return a.join(s, "city_name").join(c, "city_name").select(
        "city_name", "mean_1y", F.col("_q")[0].alias("median_1y"), F.col("_q")[1].alias("p95_1y"), "seasonal_var",
        F.log(F.col("population").cast("double")).alias("log_population"))


@query("seasonal_index", V("merged") + """
SELECT city_name, season, sm / am AS seasonal_index FROM (
  SELECT city_name, season, avg(pm25) AS sm, am FROM (
    SELECT city_name, CAST(floor((month(date) % 12) / 3) AS INTEGER) AS season, pm25,
           avg(pm25) OVER (PARTITION BY city_name) AS am FROM merged) x GROUP BY city_name, season, am) y""",
       ["seasonal_index"])
def seasonal_index(spark, d):
    """Season mean / annual mean per city."""
    m = merged(spark, d)
    s = m.groupBy("city_name", F.floor((F.month("date") % 12) / 3).cast("int").alias("season")) \
        .agg(F.avg("pm25").alias("sm"))
    a = m.groupBy("city_name").agg(F.avg("pm25").alias("am"))
    return s.join(a, "city_name").select("city_name", "season", (F.col("sm") / F.col("am")).alias("seasonal_index"))


@query("city_sensitivity", V("merged") + "SELECT city_name, " + ", ".join(
    f"regr_r2(pm25, {c}) AS r2_{c}" for c in ["temp_avg_c", "visibility_km", "wind_speed_kmh"]) +
       " FROM merged GROUP BY city_name", [f"r2_{c}" for c in ["temp_avg_c", "visibility_km", "wind_speed_kmh"]])
def city_sensitivity(spark, d):
    """Per-city R^2 of PM2.5 on a single weather variable."""
    return merged(spark, d).groupBy("city_name").agg(
        *[F.regr_r2("pm25", c).alias(f"r2_{c}") for c in ["temp_avg_c", "visibility_km", "wind_speed_kmh"]])


_BASE = ("greatest(0e0, 30e0 + 0.3e0 * (coalesce(temp_avg_c, 20e0) - 20e0) + greatest(0e0, 0.5e0 * (15e0 - "
         "coalesce(wind_speed_kmh, 10e0))) - 0.8e0 * least(coalesce(precip_mm, 0e0), 10e0))")


@query("regression_metrics", V("merged") + f"""
SELECT city_name, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1e0 - sum(e * e) / (var_pop(pm25) * count(*)) AS r2,
  count(*) AS n FROM (SELECT city_name, pm25, pm25 - greatest({_BASE}, 0e0) AS e FROM merged WHERE pm25 IS NOT NULL) t
GROUP BY city_name""", ["rmse", "mae", "r2"])
def regression_metrics(spark, d):
    """RMSE / MAE / R^2 per city of a prediction (the heuristic baseline), predictions floored at 0."""
    m = merged(spark, d).select("city_name", "pm25", FE.baseline_pm25(F.col("temp_avg_c"), F.col("wind_speed_kmh"),
                                                                       F.col("precip_mm")).alias("pred"))
    return E.regression_metrics(m, ["city_name"], "pm25", "pred")


@query("residual_report", V("merged") + f"""
SELECT count(*) AS n, avg(abs(e / pm25)) * 100e0 AS mape, avg(e) AS mean_residual, skewness(e) AS residual_skew,
  quantile_cont(e, 0.05) AS q05, quantile_cont(e, 0.5) AS q50, quantile_cont(e, 0.95) AS q95,
  avg(CASE WHEN e < 0 THEN 1e0 ELSE 0e0 END) AS over_share, avg(CASE WHEN e > 0 THEN 1e0 ELSE 0e0 END) AS under_share
FROM (SELECT pm25, pm25 - {_BASE} AS e FROM merged WHERE pm25 IS NOT NULL AND pm25 <> 0) t""",
       ["mape", "mean_residual", "residual_skew", "q05", "q50", "q95", "over_share", "under_share"])
def residual_report(spark, d):
    """MAPE, residual mean / skew / quantiles, over- and under-prediction shares."""
    m = merged(spark, d).where(F.col("pm25").isNotNull() & (F.col("pm25") != 0))
    e = F.col("pm25") - FE.baseline_pm25(F.col("temp_avg_c"), F.col("wind_speed_kmh"), F.col("precip_mm"))
    r = m.select("pm25", e.alias("e"), F.lit(1).alias("g"))
    quantiles = E.exact_quantiles(r, "g", "e", [0.05, 0.5, 0.95])  # one row
    moments = r.groupBy("g").agg(F.count("*").cast("long").alias("n"), (F.avg(F.abs(F.try_divide("e", "pm25"))) * 100).alias("mape"),
                 F.avg("e").alias("mean_residual"), E.skewness_unbiased(F.col("e")).alias("residual_skew"),
                 F.avg((F.col("e") < 0).cast("double")).alias("over_share"),
                 F.avg((F.col("e") > 0).cast("double")).alias("under_share"))
    return moments.join(quantiles, "g").select(
        "n", "mape", "mean_residual", "residual_skew", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q95"), "over_share", "under_share")


_QQ = [i / 100 for i in range(1, 100)]


@query("qq_points", V("merged", extra=[("q", "SELECT quantile_cont(pm25, [" + ", ".join(dlit(p) for p in _QQ) +
                                         "]) AS qs FROM merged WHERE pm25 IS NOT NULL")]) +
       "SELECT unnest(range(1, 100)) AS p, unnest([" + ", ".join(dlit(NormalDist().inv_cdf(p)) for p in _QQ) +
       "]) AS theoretical, unnest(qs) AS sample FROM q", ["theoretical", "sample"])
def qq_points(spark, d):
    """Q-Q pairs (sample quantiles vs standard normal quantiles at 1 %..99 %)."""
    m = merged(spark, d).where(F.col("pm25").isNotNull())
    q = E.exact_quantiles(m.select(F.lit(1).alias("g"), "pm25"), "g", "pm25", _QQ)
    theo = [NormalDist().inv_cdf(p) for p in _QQ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("p"), F.lit(theo[i]).alias("theoretical"),
                             F.col("q")[i].alias("sample")) for i in range(len(_QQ))])
    return q.select(F.explode(arr).alias("s")).select(F.col("s.p").cast("long").alias("p"), "s.theoretical",
                                                      "s.sample")


_LAMBDAS = [round(-2 + 0.1 * i, 1) for i in range(41)]


@query("boxcox_fixed", V("merged") + """
SELECT city_name, date, pm25, (pow(greatest(pm25, 0.1e0), 0.5e0) - 1e0) / 0.5e0 AS pm25_boxcox FROM merged
WHERE pm25 IS NOT NULL""", ["pm25", "pm25_boxcox"])
def boxcox_fixed(spark, d):
    """F10 with a fixed lambda (0.5): Box-Cox after clipping at 0.1."""
    m = merged(spark, d).where(F.col("pm25").isNotNull())
    x = F.greatest(F.col("pm25"), F.lit(0.1))
    return m.select("city_name", "date", "pm25", ((F.pow(x, 0.5) - 1) / 0.5).alias("pm25_boxcox"))


@query("boxcox")
def boxcox(spark, d):
    """lambda by maximum likelihood over a grid -2..2 (all lambdas in ONE aggregate), then
    a finer grid around the best, then the transform.  Rows-only (iterative)."""
    m = merged(spark, d).where(F.col("pm25").isNotNull()).select("city_name", "date", "pm25")
    x = F.greatest(F.col("pm25"), F.lit(0.1))

    def best(lams):
        aggs = [F.sum(F.log(x)).alias("_sl"), F.count("*").alias("_n")]
        for i, lam in enumerate(lams):
            y = F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)
            aggs.append(F.var_pop(y).alias(f"v{i}"))
        r = m.agg(*aggs).first()
        llf = [(lam - 1) * r["_sl"] - r["_n"] / 2.0 * math.log(r[f"v{i}"]) if r[f"v{i}"] else -math.inf
               for i, lam in enumerate(lams)]
        return lams[max(range(len(lams)), key=lambda i: llf[i])]

    lam = best(_LAMBDAS)
    lam = best([round(lam - 0.1 + 0.01 * i, 3) for i in range(21)])
    y = F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)
    return m.select("city_name", "date", "pm25", F.lit(lam).alias("lambda"), y.alias("pm25_boxcox"))


# ----------------------------------------------------------------- leaderboard
@query("algorithm_rollup", V("experiment_results") + """
SELECT algorithm, avg(val_rmse) AS mean_val_rmse, stddev_samp(val_rmse) AS std_val_rmse,
  avg(test_rmse) AS mean_test_rmse, avg(val_r2) AS mean_val_r2, count(*) AS n FROM experiment_results
GROUP BY algorithm""", ["mean_val_rmse", "std_val_rmse", "mean_test_rmse", "mean_val_r2"])
def algorithm_rollup(spark, d):
    """Metrics rolled up by algorithm."""
    r = domain.experiment_results(spark, d)
    return r.groupBy("algorithm").agg(F.avg("val_rmse").alias("mean_val_rmse"),
                                      F.stddev_samp("val_rmse").alias("std_val_rmse"),
                                      F.avg("test_rmse").alias("mean_test_rmse"), F.avg("val_r2").alias("mean_val_r2"),
                                      F.count("*").cast("long").alias("n"))


_ALGOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("mode_algo_pivot", V("experiment_results") + "SELECT mode, " + ", ".join(
    f"avg(CASE WHEN algorithm = '{a}' THEN val_rmse END) AS \"{a}\"" for a in _ALGOS) +
       " FROM experiment_results GROUP BY mode", _ALGOS)
def mode_algo_pivot(spark, d):
    """Mode x algorithm mean validation RMSE pivot."""
    r = domain.experiment_results(spark, d)
    return r.groupBy("mode").pivot("algorithm", _ALGOS).agg(F.avg("val_rmse"))


@query("best_per_mode", V("experiment_results") + """
SELECT mode, algorithm, city_id, val_rmse, test_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY mode ORDER BY val_rmse, algorithm, city_id) AS r FROM experiment_results) x
WHERE r = 1""", ["val_rmse", "test_rmse"])
def best_per_mode(spark, d):
    """Best configuration per mode by validation RMSE (ties by algorithm, city)."""
    r = domain.experiment_results(spark, d)
    w = Window.partitionBy("mode").orderBy("val_rmse", "algorithm", "city_id")
    return r.select("mode", "algorithm", "city_id", "val_rmse", "test_rmse", F.row_number().over(w).alias("_r")) \
        .where("_r = 1").drop("_r")


@query("global_best", V("experiment_results") + """
SELECT arg_min(mode, (val_rmse, algorithm, city_id)) AS mode, arg_min(algorithm, (val_rmse, algorithm, city_id)) AS algorithm,
  min(val_rmse) AS val_rmse FROM experiment_results""", ["val_rmse"])
def global_best(spark, d):
    """Global best (min_by over a struct ordering, one aggregate)."""
    r = domain.experiment_results(spark, d)
    key = F.struct("val_rmse", "algorithm", "city_id")
    return r.agg(F.min_by("mode", key).alias("mode"), F.min_by("algorithm", key).alias("algorithm"),
                 F.min("val_rmse").alias("val_rmse"))


@query("leaderboard", V("experiment_results") + """
SELECT mode, algorithm, city_id, val_rmse, CAST(rank() OVER (PARTITION BY mode ORDER BY val_rmse) AS INTEGER) AS rank_in_mode,
  avg(val_rmse) OVER (PARTITION BY algorithm) AS algo_mean_rmse FROM experiment_results""",
       ["val_rmse", "algo_mean_rmse"])
def leaderboard(spark, d):
    """Ranking within mode and per-algorithm comparison."""
    r = domain.experiment_results(spark, d)
    return r.select("mode", "algorithm", "city_id", "val_rmse",
                    F.rank().over(Window.partitionBy("mode").orderBy("val_rmse")).alias("rank_in_mode"),
                    F.avg("val_rmse").over(Window.partitionBy("algorithm")).alias("algo_mean_rmse"))


@query("param_sensitivity", V("experiment_results") + """
SELECT n_train % 10 AS param_value, avg(val_rmse) AS mean_val_rmse, count(*) AS n FROM experiment_results
GROUP BY n_train % 10""", ["mean_val_rmse"])
def param_sensitivity(spark, d):
    """Hyper-parameter value vs RMSE (value read from the results' parameter map)."""
    r = domain.experiment_results(spark, d)
    params = F.create_map(F.lit("n_bucket"), F.col("n_train") % 10)
    return r.select(F.element_at(params, F.lit("n_bucket")).alias("param_value"), "val_rmse") \
        .groupBy("param_value").agg(F.avg("val_rmse").alias("mean_val_rmse"), F.count("*").cast("long").alias("n"))
