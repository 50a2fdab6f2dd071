"""Physical-plan summary of every registered metric (the executed plan after AQE).

    python tools/plan_report.py [--sf-dir DIR] > PLANS.md

Broadcast joins are off, so the plans are those of tables too large to broadcast.  Per metric:
hash exchanges, exchanges to one partition (single-row aggregates and the final order of small
results), file scans by table, sort-merge joins, windows, Expand, and whether a cartesian product appears.
The work below a persisted frame (the cohort matrices) is part of the plan and counted.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopmetrics.plans.registry import all_queries  # noqa: E402
from shopmetrics.session import local_session  # noqa: E402


def summarize(plan: str) -> dict[str, int | str]:
    def n(pattern: str) -> int:
        return len(re.findall(pattern, plan))
    return {
        "hash": n(r"(?<!Reused)Exchange hashpartitioning"),
        "reused": n(r"ReusedExchange"),
        "single": n(r"Exchange (SinglePartition|RoundRobinPartitioning\(1\))"),
        "scans": ", ".join(f"{t} {k}" if k > 1 else t for t, k in sorted(Counter(re.findall(r"/(\w+)\.parquet\]", plan)).items())),
        "smj": n(r"SortMergeJoin"),
        "windows": n(r"\bWindow \["),
        "expand": n(r"\bExpand\b"),
        "cartesian": n(r"CartesianProduct|BroadcastNestedLoopJoin"),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = local_session(8)
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = []
    for name, q in all_queries().items():
        df = q(spark, args.sf_dir)
        df.collect()  # runs this DataFrame's own query execution: its final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        rows.append((name, summarize(plan)))
        spark.catalog.clearCache()
    cols = list(rows[0][1])
    print("# Plan shapes (executed plans at sf0.01, local[8], AQE on, broadcast joins off)\n")
    print("Generated by `tools/plan_report.py`: hash exchanges, reused ones, exchanges to one partition (single-row "
          "aggregates and the order of small results), file scans by table, joins, windows. The work below a persisted "
          "frame is counted.\n")
    print("| metric | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, s in rows:
        print(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
