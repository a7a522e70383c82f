"""Summarise the physical plans of the headline queries into PLANS.md.

usage: python tools/plan_report.py [sf_dir]

For every query: operator counts of the executed (final AQE) plan -- exchanges,
broadcasts, hash vs sort aggregates, windows -- and, per Parquet scan, the
read schema and pushed filters.  Useful to check that a change did not add a
shuffle or lose a pushdown.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from airshed.plans.registry import QUERIES, load_all  # noqa: E402
from airshed.session import build_session  # noqa: E402

HEADLINE = ["merge_daily", "idw_weather", "nearest_stations", "interpolate_time_limit", "rolling_features",
            "corr_spearman", "features_full", "daily_mean", "load_city_year", "chrono_split"]
KINDS = ["Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange", "ReusedExchange", "HashAggregate", "SortAggregate",
         "ObjectHashAggregate", "Window", "WindowGroupLimit", "SortMergeJoin", "BroadcastHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Generate"]


def summarise(df) -> tuple[dict, list[str]]:
    df.write.format("noop").mode("overwrite").save()          # run so AQE finalises the plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = collections.Counter()
    for k in KINDS:
        counts[k] = len(re.findall(rf"\b{re.escape(k)}\b", plan))
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        line = m.group(0)
        loc = re.search(r"Location: \w+ \d+ entries|Location: [^,\]]*\[([^\]]*)\]", line)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        schema = re.search(r"ReadSchema: struct<(.*?)>?$", line)
        name = os.path.basename(loc.group(1)) if loc and loc.groups() and loc.group(1) else "?"
        scans.append(f"{name}: read <{schema.group(1) if schema else '?'}>; pushed [{pushed.group(1) if pushed else ''}]")
    return dict(counts), scans


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    spark = build_session("local[4]")
    out = ["# Physical plan summary (executed AQE plans)", "",
           f"Generated by `tools/plan_report.py` on `{sf}`.", ""]
    for name in HEADLINE:
        counts, scans = summarise(QUERIES[name](spark, sf))
        nz = ", ".join(f"{k} {v}" for k, v in counts.items() if v)
        out += [f"## {name}", "", f"- operators: {nz}"]
        for s in sorted(set(scans)):
            out.append(f"- scan {s}")
        out.append("")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
