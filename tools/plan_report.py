"""Physical-plan summary of every registered batch query (markdown table on stdout).

usage: python tools/plan_report.py [sf_dir]
Counts the operators that matter at scale: exchanges, join strategies,
windows, partial aggregates, top-k, Python stages, cartesian products.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridlens.plans.catalog import load  # noqa: E402
from gridlens.session import get_spark  # noqa: E402

COLS = [("Exchange hashpartitioning", "hash exch"), ("Exchange rangepartitioning", "range exch"),
        ("Exchange SinglePartition", "single exch"), ("BroadcastHashJoin", "bcast join"),
        ("SortMergeJoin", "smj"), ("partial_", "partial agg"), ("Window [", "window"),
        ("WindowGroupLimit", "win limit"), ("TakeOrderedAndProject", "top-k"),
        ("ArrowEvalPython", "arrow udf"), ("FlatMapGroupsInPandas", "pandas grp"),
        ("FlatMapCoGroupsInPandas", "pandas cogrp"), ("CartesianProduct", "cartesian"),
        ("BroadcastNestedLoopJoin", "nested loop")]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    reg = load()
    print("| query | group | " + " | ".join(c for _, c in COLS) + " |")
    print("|---|---|" + "---|" * len(COLS))
    for name in sorted(reg, key=lambda n: (reg[n].group, n)):
        spec = reg[name]
        if spec.group == "streams":
            continue
        plan = spec.build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        # cached sub-plans are printed inside InMemoryRelation; count the top-level plan text once
        counts = [len(re.findall(re.escape(k), plan)) for k, _ in COLS]
        print(f"| `{name}` | {spec.group} | " + " | ".join(str(c) if c else "" for c in counts) + " |")


if __name__ == "__main__":
    main()
