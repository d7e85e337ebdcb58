"""What is shuffled, computed and held by one task follows the period and not the history."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest

from conftest import JAN, d, make_tables, rows

from pyspark.sql import functions as F, types as T

from tradelens.operators.facts import header_with_lines, lines_of
from tradelens.operators.rollup import read_stock_rollup, refresh_stock_rollup, stock_partials, write_stock_rollup
from tradelens.operators.stock import period_entry_by_goods
from tradelens.sources.contract import LINK_INDEX, SCHEMAS
from tradelens.sources.copartitioned import buckets_for, load_copartitioned_tables, write_copartitioned_tables
from tradelens.sources.fixtures import derive_tables

SF = "/root/testdata/sf0.001"


def _history(spark, bill_type=1102):
    """3 bills of January 2024 and 2000 of the year before; each has a line, the third of January has none."""
    bills = [dict(bill_id=i, bill_type=bill_type, bill_date=d(5) if i <= 3 else dt.datetime(2023, 5, 1), use_id=0)
             for i in range(1, 2004)]
    lines = [dict(bill_id=i, goods_id=i % 500, qty=2, price=1, amount=2, disc_rate=1) for i in range(1, 2004) if i != 3]
    lines.append(dict(bill_id=None, goods_id=7, qty=9, price=1, amount=9, disc_rate=1))
    return make_tables(spark, stock_bill=bills, stock_line=lines)


def _bitmaps(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("getbit(")


def test_lines_of_other_bills_stay_out_of_the_shuffle(spark):
    t = _history(spark)
    bills = t.stock_bill.filter(F.col("bill_date") >= dt.datetime(2024, 1, 1))
    assert {r["bill_id"] for r in rows(lines_of(t.stock_line, bills, JAN))} >= {1, 2}
    assert lines_of(t.stock_line, bills, JAN).count() < 20
    assert lines_of(t.stock_line, bills, None).count() == 2003
    got = header_with_lines(bills, t.stock_line.select("bill_id", "goods_id"), JAN)
    assert sorted((r["bill_id"], r["goods_id"] or 0) for r in rows(got)) == [(1, 1), (2, 2), (3, 0)]


def test_entries_and_open_months_are_reduced(spark):
    t = _history(spark)
    entries = period_entry_by_goods(t, JAN)
    assert _bitmaps(entries) and sorted(r["goods_id"] for r in rows(entries)) == [1, 2]
    partials = stock_partials(t, [202401])
    assert _bitmaps(partials)
    assert sorted((r["goods_id"], r["qty"]) for r in rows(partials)) == [(1, 2), (2, 2)]


def test_a_month_of_the_rollup_is_not_one_tasks(spark, tmp_path):
    t, root = _history(spark), str(tmp_path / "rollup")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for write in (lambda: write_stock_rollup(t, root), lambda: refresh_stock_rollup(t, root, [202305])):
            write()
            files = [f for f in os.listdir(f"{root}/bill_month=202305") if f.endswith(".parquet")]
            assert len(files) > 1
            assert sorted(map(str, rows(read_stock_rollup(t, root)))) == sorted(map(str, rows(stock_partials(t))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _browse(spark, n):
    schema = SCHEMAS["stock_bill_browse"]
    return spark.createDataFrame([(i, 1101, f"B{i}", d(3), Decimal(1), Decimal(1), i % 50, 1102, "X") for i in range(n)], schema)


def test_the_view_is_computed_once_for_both_of_its_copies(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.LongType())
    def counted(x):
        seen.add(1)
        return x

    view = _browse(spark, 300).withColumn("bill_id", counted("bill_id"))
    write_copartitioned_tables(spark, {"stock_bill_browse": view}, str(tmp_path), "tl_once", buckets=4)
    assert seen.value == 300
    t = load_copartitioned_tables(spark, "tl_once", ("stock_bill_browse", LINK_INDEX))
    assert sorted(map(str, rows(t.stock_bill_browse))) == sorted(map(str, rows(t[LINK_INDEX])))


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        view = _browse(spark, 20_000).repartition(16)
        write_copartitioned_tables(spark, {"stock_bill_browse": view}, str(tmp_path), "tl_dealt", buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len([f for f in os.listdir(tmp_path / "stock_bill_browse") if f.endswith(".parquet")]) > 1
    t = load_copartitioned_tables(spark, "tl_dealt", ("stock_bill_browse",))
    assert t.stock_bill_browse.select("bill_id").distinct().count() == t.stock_bill_browse.count() == 20_000


def test_buckets_follow_the_rows(spark):
    assert buckets_for({"stock_bill_browse": _browse(spark, 95)}, rows=5) == 19
    assert buckets_for({"stock_bill_browse": _browse(spark, 95)}) == 8
    t = _history(spark)  # stored by month: the 2000 bills of the largest month count
    assert buckets_for({"stock_bill": t.stock_bill, "stock_line": t.stock_line}, rows=100) == 20


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_derived_lines_read_used_columns_only(spark):
    plan = derive_tables(spark, SF).stock_line.select("bill_id")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and "l_quantity" not in plan and "l_extendedprice" not in plan
