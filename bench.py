"""Benchmark: the twelve reports over the derived ERP tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The contract tables are first derived from the test tables and written as
parquet, lines by month (reported as ``stage_contract_tables_sec``, not part of
the value). Each report is run to completion with the ``noop`` sink (all rows
produced, nothing collected to the driver) on freshly loaded tables, building
the plan included; the median of ``BENCH_REPEAT`` runs is kept. ``bundle_all_groups`` runs the four report groups with the period's facts and
pre-aggregates computed once per group and persisted; ``bundle_all_groups_concurrent`` the same
with each group's reports submitted from four threads. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradelens.functions.period import TEST_PERIOD  # noqa: E402
from tradelens.plans.bundle import persisted, run_concurrently, run_group  # noqa: E402
from tradelens.plans.reports import REPORT_GROUPS, SharedPlans  # noqa: E402
from tradelens.session import local_session, scratch_path  # noqa: E402
from tradelens.sources.fixtures import derive_tables  # noqa: E402
from tradelens.sources.tables import load_parquet_tables, write_monthly_tables  # noqa: E402

REPORT_KEYS = {
    "Bill_Relation_Purchase": "bill_relation_purchase", "Bill_Relation_Sale": "bill_relation_sale",
    "Product_Sale": "product_sale", "Product_Category_Sale": "product_category_sale",
    "Product_Never_Sold": "product_never_sold", "Customer_Product": "customer_product",
    "Customer_Product_Category": "customer_product_category", "Customer_Summary": "customer_summary",
    "Customer_Detail": "customer_detail", "Customer_Info": "customer_info",
    "Receivable_Summary": "receivable_summary", "Receivable_Detail": "receivable_detail",
}


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16,
                          app_name="tradelens-bench")
    # The ERP tables are stored tables in real use: derive them from the test
    # tables once, write them as parquet (timed separately), then time the
    # reports over parquet scans.
    t0 = time.perf_counter()
    root = scratch_path(spark, "bench-tables")
    write_monthly_tables(derive_tables(spark, sf_dir), root)
    stage_tables = round(time.perf_counter() - t0, 3)
    t = load_parquet_tables(spark, root)
    _run(t.stock_bill.select("bill_id"))  # warm-up

    timings: dict[str, float] = {}
    for group, reports in REPORT_GROUPS.items():
        for sheet, fn in reports:
            runs = []
            for _ in range(repeat):
                fresh = load_parquet_tables(spark, root)
                t0 = time.perf_counter()
                _run(fn(fresh, TEST_PERIOD))
                runs.append(time.perf_counter() - t0)
            timings[REPORT_KEYS[sheet]] = round(statistics.median(runs), 3)

    t0 = time.perf_counter()
    for group in REPORT_GROUPS:
        shared = SharedPlans(t, TEST_PERIOD, stage=persisted)
        for df in run_group(t, group, TEST_PERIOD, shared).values():
            _run(df)
        shared.release()
    bundle = round(time.perf_counter() - t0, 3)

    # the same, with each group's reports submitted concurrently
    t0 = time.perf_counter()
    for group in REPORT_GROUPS:
        shared = SharedPlans(t, TEST_PERIOD, stage=persisted)
        run_concurrently(run_group(t, group, TEST_PERIOD, shared), lambda _n, df: _run(df))
        shared.release()
    bundle_parallel = round(time.perf_counter() - t0, 3)

    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "reports_total_median_sec", "value": total, "unit": "sec",
                      "queries": {**timings, "bundle_all_groups": bundle,
                                  "bundle_all_groups_concurrent": bundle_parallel},
                      "stage_contract_tables_sec": stage_tables,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
