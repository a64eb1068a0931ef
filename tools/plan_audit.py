"""Summarise the executed (adaptive) physical plan of every registered query.

Usage: python tools/plan_audit.py [sf_dir] > PLANS.md
Results are collected, so use a small folder.
For each query: shuffle exchanges, broadcast exchanges, sort-merge joins,
Python (pandas) stages, windows, parquet scans and whether every scan reads a
pruned column set.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from setscore.plans.catalog import QUERIES  # noqa: E402
from setscore.session import get_session  # noqa: E402

PATTERNS = {
    "shuffles": r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
    "broadcasts": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "pandas": r"(FlatMapGroupsInPandas|MapInPandas|MapInArrow|ArrowEvalPython)",
    "windows": r"\bWindow\b",
    "scans": r"FileScan parquet",
}


def plan_text(df) -> str:
    df.collect()          # of this very query execution, so that adaptive execution has settled its plan
    text = df._jdf.queryExecution().executedPlan().toString()
    if text.startswith("AdaptiveSparkPlan isFinalPlan=false"):       # a subquery's may stay open where it wasn't needed
        raise RuntimeError("the plan is not the executed one")
    return text.split("== Initial Plan ==")[0]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16)
    rows = []
    for name, fn in QUERIES.items():
        text = plan_text(fn(spark, sf_dir))
        counts = {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}
        schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
        full_scan = any("embedding" not in s and s.count(":") > 6 for s in schemas)
        rows.append((name, counts, "no" if full_scan else "yes"))
    print("# Executed plans at", os.path.basename(sf_dir.rstrip("/")))
    print()
    print("Counts from the final adaptive plan of each registered query (after it ran).")
    print("Reused exchanges count once; jobs that write intermediate tables are not counted.")
    print()
    print("| query | shuffles | broadcasts | sort-merge joins | broadcast joins | pandas stages | windows | parquet scans | pruned reads |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, c, pruned in rows:
        print(f"| `{name}` | {c['shuffles']} | {c['broadcasts']} | {c['smj']} | {c['bhj']} | {c['pandas']} | "
              f"{c['windows']} | {c['scans']} | {pruned} |")


if __name__ == "__main__":
    main()
