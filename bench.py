"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan is executed with the ``noop`` sink (no driver collect).  The ETL (station-days
and the merged table, stored once) is timed first, as a line of its own in ``extra`` and part of the
total, so no headline query pays for it; a full-strength forest and the boosting of every city are
further lines (BENCH_MODELS=none leaves them out).
Before timing, every headline query runs once on the smallest scale factor
($BENCH_WARMUP_DIR, default /root/testdata/sf0.001): that warms the JVM JIT and
Spark's generated-code cache (keyed by plan shape), so the timed pass measures
execution rather than one-off compilation.  No data or stored table is shared
between the two scale factors.  Set BENCH_WARMUP_DIR="" to time cold runs.
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "idw_weather",
    "rolling_features",
    "nearest_stations",
    "interpolate_time_limit",
    "corr_spearman",
    "merge_daily",
    "merged_aqi",
    "features_full",
    "daily_mean",
    "stream_daily_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    from airshed.plans.registry import QUERIES, load_all
    from airshed.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(cpus, 8))),
                          app="airshed-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "6g"),
                                 # a folder of this run's own, so that no earlier run's stored tables are read
                                 "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="airshed-bench-")})
    load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    else:
        warm_dir = ""
        QUERIES["safe_city"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    from airshed.plans.pipeline import stored_merged

    extra = {}
    t0 = time.perf_counter()
    stored_merged(spark, sf_dir)
    extra["etl_stored_tables"] = round(time.perf_counter() - t0, 3)
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    # both tree algorithms at their full settings: a forest of all rows, and boosting of every city
    if os.environ.get("BENCH_MODELS", "") != "none":
        from airshed.operators import experiments as EX

        table = stored_merged(spark, sf_dir)
        for name, run in (("forest_GTS", lambda: EX.global_forest(table, ["GTS"])), ("boosting_city_CTS", lambda: EX.city_trees(table, "CTS", ["GradientBoosting"]))):
            t0 = time.perf_counter()
            run().collect()
            extra[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_time",
        "value": round(sum(times.values()) + extra["etl_stored_tables"], 3),  # the ETL included
        "unit": "sec",
        "queries": times,
        "extra": extra,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "warmup": f"one pass of the same queries on {warm_dir}" if warm_dir else "none (cold)",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
