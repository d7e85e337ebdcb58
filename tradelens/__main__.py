"""Command line: write the reports of one or more groups for a period.

    python -m tradelens --tables /data/erp --start 1997-01-01 --end 1997-01-20 \
        --group Sale_Report --group Customer_Report --out /reports [--format csv]

Uses the active session if there is one (``spark-submit``), a local one
otherwise. ``--catalog DB`` reads catalog tables (e.g. the bucketed layout)
instead of parquet folders.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tradelens.functions.period import Period
from tradelens.plans.bundle import write_report_bundle
from tradelens.plans.reports import REPORT_GROUPS
from tradelens.sources.tables import load_catalog_tables, load_parquet_tables


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tradelens", description=__doc__.split("\n\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with one parquet folder per contract table")
    src.add_argument("--catalog", help="catalog database holding the contract tables")
    ap.add_argument("--start", required=True, help="first day, YYYY-MM-DD")
    ap.add_argument("--end", required=True, help="last day, YYYY-MM-DD")
    ap.add_argument("--group", action="append", choices=sorted(REPORT_GROUPS),
                    help="report group (repeatable; default: all)")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    ap.add_argument("--share", choices=("persist", "write", "none"), default="persist",
                    help="how a group's shared facts are held")
    args = ap.parse_args(argv)

    spark = SparkSession.getActiveSession()
    if spark is None:
        from tradelens.session import local_session
        spark = local_session()
    t = load_catalog_tables(spark, args.catalog) if args.catalog else load_parquet_tables(spark, args.tables)
    period = Period.parse(args.start, args.end)
    share = None if args.share == "none" else args.share
    for group in args.group or list(REPORT_GROUPS):
        folder = write_report_bundle(spark, t, group, period, args.out, fmt=args.format, share=share)
        print(folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
