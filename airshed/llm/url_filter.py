"""URL filter: a sort-merge range join of urls with nested rules (DataFrame operations only).

A rule ``(host, path, verdict)`` fits its host and all subdomains where the url's path starts
with the rule's.  Its key is the reversed host, ``/`` and the path, so it covers exactly the
keys that start with its own: an interval.  A url asks with one point for each host length
(in labels) that any rule has: its last labels reversed, ``/`` and its path.  Openings,
closings and points are range-partitioned by key and swept in order: the running count of
openings less closings is the height of the stack, the last rule opened at each height is
its slot, and a slot is active at a point that starts with its key.  What is open at the
start of a range is carried in from the ranges before it (one row for each range).

Cases: a null url, or one without ``://``, has an empty host and path, which no rule fits.
Rules with a null or empty host or null verdict are ignored; a null path is empty.  Of rules
with one host and path, block wins.  Longest means characters of host and path together,
then of the host.  Repeated urls are asked once and joined back; repeated or null page_ids
are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airshed.llm.common import Scratch, read, with_columns

#: The rules of op3.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, POINT, CLOSE = 0, 1, 2


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column, labels: Column | None = None) -> Column:
    parts = F.reverse(F.split(host, r"\."))
    return F.array_join(parts if labels is None else F.slice(parts, F.lit(1), labels), ".")


def _key(host: Column, path: Column, labels: Column | None = None) -> Column:
    return F.concat(_reversed(host, labels).cast("binary"), F.lit("/").cast("binary"), path.cast("binary"))


def _rules(rules: DataFrame) -> DataFrame:
    host = F.translate(F.col("host"), UPPER, LOWER)
    clean = rules.where((F.coalesce(F.col("host"), F.lit("")) != "") & F.col("verdict").isNotNull()).select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        "host", "path", "verdict", _key(F.col("host"), F.col("path")).alias("key"), F.size(F.split("host", r"\.")).alias("labels")
    )


def sweep(points: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """The longest rule active at each distinct point: (host, path, labels, best struct).

    points: (host, path, labels, key); rules: as from ``_rules``."""
    rule = F.struct("key", F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    opened = rules.select(F.col("key").alias("at"), F.lit(OPEN).alias("kind"), rule.alias("r"))
    closed = rules.select(F.concat("key", F.lit(b"\xff")).alias("at"), F.lit(CLOSE).alias("kind"), F.lit(None).cast(opened.schema["r"].dataType).alias("r"))
    asked = points.select(F.col("key").alias("at"), F.lit(POINT).alias("kind"), "host", "path", "labels")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = opened.unionByName(closed).unionByName(asked, allowMissingColumns=True)
    # The written range number is stable, unlike that of a range partitioning made twice.
    events = scratch.keep(events.repartitionByRange(parts, "at").withColumn("range", F.spark_partition_id()), "events")

    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    height = events.groupBy("range").agg(F.sum(step).alias("up")).select("range", F.coalesce(F.sum("up").over(by_range), F.lit(0)).alias("base"))
    order = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stacked = events.join(height.hint("merge"), "range").withColumn("height", F.col("base") + F.sum(step).over(order))
    tops = stacked.where(F.col("kind") == OPEN).agg(F.max("height")).first()[0] or 0
    slots = [f"s{h}" for h in range(1, tops + 1)]
    at_height = [F.when((F.col("kind") == OPEN) & (F.col("height") == h), F.col("r")) for h in range(1, tops + 1)]
    stacked = stacked.withColumns({s: F.last(x, ignorenulls=True).over(order) for s, x in zip(slots, at_height, strict=True)})
    # A slot left by the ranges before: the last opening at that height in the nearest range that has one.
    left = stacked.groupBy("range").agg(*[F.max_by(s, F.struct("at", "kind")).alias(f"end_{s}") for s in slots], F.count(F.lit(1)).alias("rows"))
    left = left.select("range", *[F.last(f"end_{s}", ignorenulls=True).over(by_range).alias(f"in_{s}") for s in slots])
    asked = stacked.where(F.col("kind") == POINT).join(left.hint("merge"), "range")
    active = [F.coalesce(s, f"in_{s}") for s in slots]
    fits = [F.when(F.startswith(F.col("at"), a["key"]), F.struct(a["size"].alias("size"), a["host_size"].alias("host_size"), a["rule"].alias("rule"), a["verdict"].alias("verdict"))) for a in active]
    return asked.select("host", "path", (F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")).alias("best"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    with_columns(pages, "page_id", "url")
    scratch = Scratch(spark, "urls")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    clean = scratch.keep(_rules(rules), "rules")
    lengths = [r[0] for r in clean.select("labels").distinct().orderBy("labels").collect()]  # at most the labels of a host name
    asked = urls.where(F.col("host") != "").groupBy("host", "path").agg(F.lit(1).alias("one"))
    labels = F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size(F.split("host", r"\."))))
    points = asked.select("host", "path", labels.alias("labels")).withColumn("key", _key(F.col("host"), F.col("path"), F.col("labels")))
    best = sweep(points, clean, scratch).where(F.col("best").isNotNull()).groupBy("host", "path").agg(F.max("best").alias("best"))
    found = scratch.keep(best.select("host", "path", "best.rule", "best.verdict"), "found")
    out = urls.join(found.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return scratch.finish(out)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
