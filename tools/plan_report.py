"""Write PLANS.md: the physical-plan shape of every registered query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts come from the plan before execution (AQE off), so they show what the
optimizer chose, not runtime coalescing.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from labelforge.plans.explain import plan_summary
    from labelforge.plans.registry import ORACLES as os_, QUERIES as qs, load_all
    from labelforge.session import get_spark

    spark = get_spark()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    load_all()
    print("# PLANS — physical plan shape per query\n")
    print(f"Generated by `tools/plan_report.py` over `{sf_dir}` with AQE off (the optimizer's choice before runtime "
          "re-planning). `shuffles` counts hash/range/single-partition exchanges, `bcast` broadcast exchanges, "
          "`python` Arrow/Python plan nodes, `sortagg`/`hashagg` aggregate operators, `unbounded_single` "
          "single-partition exchanges not fed by a partial aggregate. Queries that stage files show only the "
          "plan of their final read.\n")
    print("| query | oracle | shuffles | bcast | python | sortagg | hashagg | unbounded_single |")
    print("| --- | --- | ---: | ---: | ---: | ---: | ---: | ---: |")
    for name, q in qs.items():
        s = plan_summary(q(spark, sf_dir))
        print(f"| {name} | {'SQL' if name in os_ else 'rows'} | {s['shuffle_exchanges']} | {s['broadcast_exchanges']} | "
              f"{s['python_nodes']} | {s['sort_aggregates']} | {s['hash_aggregates']} | {s['unbounded_single_partition']} |")


if __name__ == "__main__":
    main(sys.argv)
