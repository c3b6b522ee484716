"""Plan inspection helpers used by tests and the README plan notes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow",
                "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas")


def physical_plan(df: DataFrame) -> str:
    """The physical plan as planned before execution (AQE's initial plan)."""
    return df._jdf.queryExecution().executedPlan().toString()


def plan_summary(df: DataFrame) -> dict[str, int]:
    """Counts of shuffles, broadcasts, Python nodes and scans in the plan."""
    p = physical_plan(df)
    return {
        "shuffle_exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|"
                                            r"RoundRobinPartitioning)", p)),
        "broadcast_exchanges": p.count("BroadcastExchange"),
        "python_nodes": sum(p.count(n) for n in PYTHON_NODES),
        "sort_aggregates": p.count("SortAggregate"),
        "hash_aggregates": p.count("HashAggregate"),
        "parquet_scans": p.count("FileScan parquet"),
        "single_partition": p.count("Exchange SinglePartition"),
        "unbounded_single_partition": _unbounded_single(p),
    }


def _unbounded_single(plan: str) -> int:
    """Single-partition exchanges fed by raw rows (a global window or sort).

    A global aggregate also ends in ``Exchange SinglePartition`` but is fed by a
    partial aggregate — one row per task — which is bounded."""
    lines = plan.splitlines()
    n = 0
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if "partial_" not in child:
                n += 1
    return n
