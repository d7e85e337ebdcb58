"""Summarise the physical plan of every report in both regimes.

    python scripts/plan_summary.py [tables_dir] [--formatted OUT_DIR]

``tables_dir`` holds the contract tables as parquet folders (default: derive
them from /root/testdata/sf0.01 into a fresh temp folder). For each report,
counts operators of the planned physical plan twice:

* ``small``: the size bounds hold (test scale) — lookups and reductions are
  broadcast;
* ``scale``: every bound fails and Spark's own size-based broadcast is off —
  the plan a 100 TB run gets.

``--formatted`` also writes ``explain("formatted")`` text per report/regime.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradelens.functions.period import TEST_PERIOD  # noqa: E402
from tradelens.plans.reports import REPORT_GROUPS  # noqa: E402
from tradelens.session import local_session  # noqa: E402
from tradelens.sources.fixtures import derive_tables  # noqa: E402
from tradelens.sources.tables import load_parquet_tables, write_parquet_tables  # noqa: E402

PATTERNS = {
    "scans": r"FileScan parquet",
    "shuffles": r"Exchange hashpartitioning",
    "range_sorts": r"Exchange rangepartitioning",
    "broadcasts": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "semi_reductions": r"LeftSemi",
    "reused_exchanges": r"ReusedExchange",
    "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
}


def summary(plan: str) -> dict[str, int]:
    final = plan.split("== Initial Plan ==")[0]  # AQE prints the final plan first
    return {k: len(re.findall(p, final)) for k, p in PATTERNS.items()}


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    out_dir = None
    if "--formatted" in sys.argv:
        out_dir = sys.argv[sys.argv.index("--formatted") + 1]
        args = [a for a in args if a != out_dir]
        os.makedirs(out_dir, exist_ok=True)
    spark = local_session()
    if args:
        root = args[0]
    else:
        root = tempfile.mkdtemp(prefix="tradelens-plans-")
        write_parquet_tables(derive_tables(spark, "/root/testdata/sf0.01"), root)
    t = load_parquet_tables(spark, root)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    print("| report | regime | " + " | ".join(PATTERNS) + " |")  # counts per plan
    print("| --- | --- | " + " | ".join("---" for _ in PATTERNS) + " |")
    for regime in ("small", "scale"):
        if regime == "scale":
            for k in keys:
                spark.conf.set(k, "-1")
        for group, reports in REPORT_GROUPS.items():
            for sheet, fn in reports:
                df = fn(t, TEST_PERIOD)
                df.collect()  # runs this DataFrame's own plan: AQE's final plan shows reuse
                plan = df._jdf.queryExecution().executedPlan().toString()
                s = summary(plan)
                print(f"| {sheet} | {regime} | " + " | ".join(str(s[k]) for k in PATTERNS) + " |")
                if out_dir:
                    with open(f"{out_dir}/{sheet}.{regime}.txt", "w") as fh:
                        fh.write(df._sc._jvm.PythonSQLUtils.explainString(
                            df._jdf.queryExecution(), "formatted"))
    spark.stop()


if __name__ == "__main__":
    main()
