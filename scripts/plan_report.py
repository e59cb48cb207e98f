"""Summarise the physical plan of every registered query (docs/PLANS.md).

usage: python scripts/plan_report.py [sf_dir] > docs/PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.registry import all_queries  # noqa: E402
from tidewater.session import build_session  # noqa: E402

PATTERNS = {
    "scans": r"FileScan parquet",
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition",
    "single_partition": r"Exchange SinglePartition",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "window_limit_partial": r"WindowGroupLimit .*Partial",
    "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py` on `{sf}` (plans before AQE re-optimisation; "
          "AQE may still turn sort-merge joins on small sides into broadcast joins at runtime).\n")
    print("| query | scans | shuffles | to one partition | broadcast hash joins | sort-merge joins | "
          "nested loop / cartesian | partial window limit | python |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, q in sorted(all_queries().items()):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        print(f"| {name} | " + " | ".join(str(counts[k]) for k in PATTERNS) + " |")


if __name__ == "__main__":
    main()
