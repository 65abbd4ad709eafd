"""Summarise physical plans: exchanges, joins, aggregates per registered query.

Usage: python tools/plans.py [sf_dir] [--no-broadcast] name ...
``--no-broadcast`` sets the broadcast threshold to -1, as if every table
were too large to broadcast (the shape at warehouse scale).
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driver_queries import QUERIES  # noqa: E402
from care_analytics.session import local_session  # noqa: E402

OPS = r"(Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning|" \
      r"Exchange SinglePartition|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|" \
      r"ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|HashAggregate|ObjectHashAggregate|" \
      r"SortAggregate|Window|Generate|TakeOrderedAndProject|FileScan parquet|BatchEvalPython|ArrowEvalPython)"


def summary(df) -> dict[str, int]:
    return dict(Counter(re.findall(OPS, df._jdf.queryExecution().executedPlan().toString())))


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    no_bc = "--no-broadcast" in args
    names = [a for a in args if not a.startswith("--")]
    spark = local_session(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan, before AQE re-plans
    if no_bc:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in names:
        s = summary(QUERIES[name](spark, sf))
        print(f"| {name} | " + ", ".join(f"{k} {v}" for k, v in sorted(s.items())) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
