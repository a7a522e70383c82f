"""Exploratory statistics as aggregates.

Most reports are one ``agg`` (partial aggregation before the shuffle) or a
``groupBy(city)``; wide-to-long reshaping uses ``unpivot`` so one aggregate
covers every variable.  Global ranks (Spearman) are computed without a global
single-partition window: distinct values are range-bucketed on approximate
quantile cut points, per-bucket counts give each bucket's offset, and ranks
are local to the bucket (``avg_rank_table``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airshed.functions.units import snap

#: Slots of groups that are counted together before any is counted by itself.
SLOTS = 1 << 20


def long_form(df: DataFrame, ids: list[str], cols: list[str], var: str = "variable", val: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, var, val)


def skewness_unbiased(c: Column) -> Column:
    """Bias-corrected sample skewness (pandas/DuckDB) from Spark's population skewness."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def missing_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return long_form(one, ["_n"], cols, "variable", "n_missing").select(
        "variable", F.col("n_missing").cast("long").alias("n_missing"),
        (F.col("n_missing") * F.lit(100.0) / F.col("_n")).alias("pct_missing"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear interpolation), max per variable."""
    lf = long_form(df.select(*cols), [], cols).where(F.col("value").isNotNull())
    moments = lf.groupBy("variable").agg(
        F.count("value").cast("long").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return moments.join(exact_quantiles(lf, "variable", "value", [0.25, 0.5, 0.75]), "variable").select(
        "variable", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"), "max")


def _bucketed(df: DataFrame, group: str, col: str, n_buckets: int, accuracy: int, few: bool = True):
    """Distinct values with their counts and a range bucket, and each bucket's count and offset.
    The cut points are broadcast where the groups are ``few``."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    vals = df.groupBy(group, col).agg(F.count(F.lit(1)).alias("_cnt"))
    cuts = vals.groupBy(group).agg(F.array_sort(F.array_distinct(
        F.percentile_approx(col, probs, accuracy))).alias("_cuts"))
    b = vals.join(F.broadcast(cuts) if few else cuts, group).select(
        group, col, "_cnt", F.size(F.filter("_cuts", lambda c: c < F.col(col))).alias("_bucket"))
    per_bucket = b.groupBy(group, "_bucket").agg(F.sum("_cnt").alias("_bcnt"))
    # offsets over (group, bucket) rows: bounded by groups x n_buckets
    ow = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return b, per_bucket.select(group, "_bucket", "_bcnt", F.coalesce(F.sum("_bcnt").over(ow), F.lit(0)).alias("_off"))


def exact_quantiles(df: DataFrame, group: str, col: str, probs: list[float], n_buckets: int = 64,
                    accuracy: int = 10000, few: bool = True) -> DataFrame:
    """(group, q: array in the order of ``probs``): exact quantiles with linear interpolation, NULLs
    skipped, without holding a group's values in one task.

    Distinct values go to range buckets as in ``avg_rank_table``; the buckets' offsets tell which
    bucket holds the two order statistics of each quantile, and only those buckets are searched."""
    d = df.where(F.col(col).isNotNull()).select(group, F.col(col).cast("double").alias(col))
    b, offsets = _bucketed(d, group, col, n_buckets, accuracy, few)
    total = offsets.groupBy(group).agg(F.sum("_bcnt").alias("_n"))
    asked = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_k", "_p")
    asked = total.select(group, "_n", asked).withColumn("_h", (F.col("_n") - 1) * F.col("_p"))
    ends = F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_at")
    asked = asked.select(group, "_k", "_h", ends)
    # groups x probabilities x buckets rows
    placed = asked.join(offsets, group).where((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_bcnt")))
    w = Window.partitionBy(group, "_bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    needed = placed.select(group, "_bucket").distinct()
    runs = b.join(needed, [group, "_bucket"], "left_semi").withColumn("_below", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    inside = F.col("_at") - F.col("_off")
    hit = runs.join(placed, [group, "_bucket"]).where((inside >= F.col("_below")) & (inside < F.col("_below") + F.col("_cnt")))
    q = hit.groupBy(group, "_k", "_h").agg(F.min_by(col, "_at").alias("_lo"), F.max_by(col, "_at").alias("_hi"))
    q = q.select(group, "_k", (F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo"))).alias("_v"))
    return q.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda e: e["_v"]).alias("q"))


def group_quantiles(df: DataFrame, group: str, col: str, probs: list[float], large: int = 10_000, also=()) -> DataFrame:
    """``exact_quantiles`` of many groups, most of them small, with the aggregates ``also`` of the same rows.

    A group of up to ``large`` values is ranked in one sorted window, which its aggregates share; the others go by
    range buckets.  Both ways give the same exact values.  Groups are counted by slots of their hash first: only
    those of slots with more than ``large`` values are counted by themselves, so without such slots no group is."""
    d = df.where(F.col(col).isNotNull()).select(group, F.col(col).cast("double").alias(col))
    slots = d.select(F.pmod(F.xxhash64(group), F.lit(SLOTS)).alias("_slot")).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    crowded = slots.where(F.col("_n") > large).select("_slot")
    if crowded.isEmpty():
        return _ranked_quantiles(d, group, col, probs, also)
    there = d.withColumn("_slot", F.pmod(F.xxhash64(group), F.lit(SLOTS))).join(crowded, "_slot", "left_semi")
    hot = there.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(group)
    small = _ranked_quantiles(d.join(hot, group, "left_anti"), group, col, probs, also)
    of_hot = d.join(hot, group, "left_semi")
    found = exact_quantiles(of_hot, group, col, probs, few=False)
    return small.unionByName(found.join(of_hot.groupBy(group).agg(*also), group) if also else found)


def _ranked_quantiles(d: DataFrame, group: str, col: str, probs: list[float], also) -> DataFrame:
    """Quantiles (linear interpolation) from each value's place in its group: one shuffle and one sort."""
    w = Window.partitionBy(group).orderBy(col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = d.select(group, col, (F.row_number().over(w) - 1).alias("_at"), F.count(F.lit(1)).over(whole).alias("_n"))
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ends = [F.max(F.when(F.col("_at") == side(at), F.col(col))).alias(f"_{name}{i}")
            for i, at in enumerate(place) for name, side in (("lo", F.floor), ("hi", F.ceil))]
    g = r.groupBy(group).agg(F.max("_n").alias("_n"), *ends, *also)
    q = [F.when(F.floor(at) == F.ceil(at), F.col(f"_lo{i}")).otherwise(
        (F.ceil(at) - at) * F.col(f"_lo{i}") + (at - F.floor(at)) * F.col(f"_hi{i}")) for i, at in enumerate(place)]
    return g.withColumn("q", F.array(*q)).drop("_n", *[f"_{name}{i}" for i in range(len(probs)) for name in ("lo", "hi")])


def avg_rank_table(df: DataFrame, group: str, col: str, out: str, n_buckets: int = 64,
                   accuracy: int = 10000) -> DataFrame:
    """(group, value, average rank) for every distinct value, without sorting a group in one task.

    1. count rows per distinct (group, value) -- partial aggregation, so a hot value (even a
       third of all rows) becomes one row;
    2. range-bucket the distinct values on per-group approximate cut points and take per-bucket
       offsets (a table of groups x n_buckets rows);
    3. inside a bucket, a running sum over the distinct values gives the rows strictly below,
       so avg_rank(v) = below(v) + (count(v) + 1) / 2;
    4. callers join the ranks back on (group, value) -- an equi-join on a unique key that AQE's
       skew handling can split."""
    b, offsets = _bucketed(df.select(group, col), group, col, n_buckets, accuracy)
    offsets = offsets.select(group, "_bucket", "_off")
    w = Window.partitionBy(group, "_bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(F.broadcast(offsets), [group, "_bucket"]).select(
        group, col, (F.col("_off") + F.coalesce(F.sum("_cnt").over(w), F.lit(0))
                     + (F.col("_cnt") + 1) / F.lit(2.0)).alias(out))


def grouped_avg_rank(df: DataFrame, group: str, col: str, out: str, n_buckets: int = 64) -> DataFrame:
    """``df`` with the average rank of ``col`` within ``group`` attached (see ``avg_rank_table``)."""
    return df.join(avg_rank_table(df, group, col, out, n_buckets), [group, col]).select(*df.columns, out)


def pattern_ranks(long: DataFrame, m: int, n_buckets: int = 64, accuracy: int = 10000) -> DataFrame:
    """(v, x, ranks) of every distinct value x of every variable v: its average rank among the rows that have
    variable j too, for each j.  ``long`` holds (v, x, there: bit j is set where the row has variable j).

    As in ``avg_rank_table``, with a count for each j instead of one."""
    of = range(m)
    vals = long.groupBy("v", "x").agg(*[F.sum(F.getbit("there", F.lit(j)).cast("long")).alias(f"c{j}") for j in of])
    cuts = vals.groupBy("v").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", [i / n_buckets for i in range(1, n_buckets)], accuracy))).alias("_cuts"))
    b = vals.join(F.broadcast(cuts), "v").withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("x")))).drop("_cuts")
    # variables x buckets rows
    before = Window.partitionBy("v").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("v", "_bucket").agg(*[F.sum(f"c{j}").alias(f"s{j}") for j in of])
    offsets = sums.select("v", "_bucket", *[F.coalesce(F.sum(f"s{j}").over(before), F.lit(0)).alias(f"o{j}") for j in of])
    below = Window.partitionBy("v", "_bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    rank = [F.col(f"o{j}") + F.coalesce(F.sum(f"c{j}").over(below), F.lit(0)) + (F.col(f"c{j}") + 1) / F.lit(2.0) for j in of]
    return b.join(F.broadcast(offsets), ["v", "_bucket"]).select("v", "x", F.array(*rank).alias("ranks"))


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]], n_buckets: int = 64) -> DataFrame:
    """Spearman rho of many pairs, each over the rows that have both variables.

    A variable's ranks among the rows that have another one follow from its values' counts by the other's
    presence, so every value is ranked once for all pairs; each row then gets its variables' rank vectors, and
    one aggregate by pair gives all correlations."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    if len(cols) > 63:
        raise ValueError("presence is kept in 63 bits")
    # ranks are taken on values snapped to 1e-9 so ties do not depend on summation order
    x = [snap(F.col(c).cast("double")) for c in cols]
    there = sum((F.when(F.col(c).isNotNull(), 1 << j).otherwise(0).cast("long") for j, c in enumerate(cols)), F.lit(0).cast("long"))
    rows = df.select(there.alias("there"), F.array(*x).alias("_x"), F.monotonically_increasing_id().alias("_row"))
    long = rows.select("_row", "there", F.posexplode("_x").alias("v", "x")).where(F.col("x").isNotNull())
    ranked = long.join(pattern_ranks(long, len(cols), n_buckets), ["v", "x"])
    # at most a vector for each variable of a row
    one = ranked.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("v", "ranks"))).alias("r"))
    one = one.select(*[F.element_at("r", F.lit(j)).alias(f"r{j}") for j in range(len(cols))])
    at = {c: j for j, c in enumerate(cols)}
    # a row's pairs stay in its task: their sums alone are shuffled
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"r{at[a]}")[at[b]].alias("x"), F.col(f"r{at[b]}")[at[a]].alias("y")) for i, (a, b) in enumerate(pairs)]))
    both = one.select(each.alias("s")).select("s.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    res = both.groupBy("pair").agg(F.corr("x", "y").alias("rho"), F.count(F.lit(1)).cast("long").alias("n"))
    names = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2")) for a, b in pairs])
    return res.select(F.element_at(names, F.col("pair") + 1).alias("v"), "rho", "n").select("v.*", "rho", "n")


def corr_matrix(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(var1, var2, r, n) of every pair over the rows that have both, in one aggregate."""
    one = df.agg(*[F.corr(a, b).alias(f"r|{a}|{b}") for a, b in pairs],
                 *[F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n|{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"`r|{a}|{b}`").alias("r"),
                                        F.col(f"`n|{a}|{b}`").cast("long").alias("n")) for a, b in pairs])).alias("s")
    return one.select(rows).select("s.*")


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(r.isNull(), F.lit(None)).when(a > 0.5, "strong").when(a > 0.3, "moderate").otherwise("weak")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed."""
    d = df.where(F.col(col).isNotNull())
    mm = scalars(d, F.min(col).alias("mn"), F.max(col).alias("mx"))
    mn, mx = F.lit(mm["mn"]).cast("double"), F.lit(mm["mx"]).cast("double")
    idx = F.least(F.floor((F.col(col) - mn) / (mx - mn) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    return d.groupBy(idx.alias("bin")).agg(F.count("*").cast("long").alias("count")).select(
        "bin", (mn + F.col("bin") * (mx - mn) / F.lit(float(bins))).alias("lo"),
        (mn + (F.col("bin") + 1) * (mx - mn) / F.lit(float(bins))).alias("hi"), "count")


def scalars(df: DataFrame, *aggs: Column) -> dict:
    """A fitted one-row statistic brought back as Python values (bounded: one row)."""
    return df.agg(*aggs).first().asDict()


def boxplot_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    d = df.where(F.col(col).isNotNull())
    # a group may be a month of all cities: its values are never held in one task
    q = exact_quantiles(d, key, col, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    q = q.select(key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.select("*", (F.col("q3") - F.col("q1")).alias("iqr"))
    lo = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi = F.col("q3") + F.lit(1.5) * F.col("iqr")
    j = d.join(q, key)
    inside = (F.col(col) >= lo) & (F.col(col) <= hi)
    return j.groupBy(key, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_low"), F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))


def level_of(c: Column, levels) -> Column:
    """Bucket label for descending thresholds [(35, 'high'), (15, 'medium'), (10, 'low')] else 'clean'."""
    s = snap(c)
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for thr, label in levels:
        expr = expr.when(s > F.lit(thr), F.lit(label)) if label == "high" else expr.when(s >= F.lit(thr), F.lit(label))
    return expr.otherwise(F.lit("clean"))


def regression_metrics(df: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    """RMSE / MAE / R2 per group (predictions floored at 0)."""
    p = F.greatest(F.col(yhat), F.lit(0.0))
    e = F.col(y) - p
    d = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    g = d.select(*keys, F.col(y).alias("_y"), e.alias("_e"))
    agg = g.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"),
        F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.count("*").cast("long").alias("n"),
        F.var_pop("_y").alias("_var"))
    return agg.select(*keys, "rmse", "mae",
                      (F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("n"))).alias("r2"), "n")
