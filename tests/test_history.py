"""Stored layouts and maintained totals: plans that follow the period, results that equal the plain ones."""

from __future__ import annotations

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import d, line, make_tables
from tradelens.functions.period import TEST_PERIOD, Period
from tradelens.operators.reduce import may_match
from tradelens.operators.rollup import (ROLLUP, load_stock_rollup, read_stock_rollup, refresh_stock_rollup, stale_months,
                                        write_stock_rollup)
from tradelens.operators.stock import import_by_goods, net_stock_by_goods
from tradelens.plans import bundle, reports as R
from tradelens.plans.bundle import repair_group, write_report_bundle
from tradelens.sources.contract import LINK_INDEX, MONTH, Tables
from tradelens.sources.copartitioned import (MONTHLY, load_copartitioned_tables, refresh_months, with_month,
                                             write_copartitioned_tables)
from tradelens.sources.fixtures import derive_tables

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def derived(spark):
    return derive_tables(spark, SF)


@pytest.fixture(scope="module")
def layout(spark, derived, tmp_path_factory):
    write_copartitioned_tables(spark, derived, str(tmp_path_factory.mktemp("layout")), "tl_layout", buckets=8)
    return load_copartitioned_tables(spark, "tl_layout")


# ------------------------------------------------------------------ link index

def _exchanged_tables(plan: str, exchange: str = "Exchange ") -> set[str]:
    """Tables that are read right below an exchange: nothing but filters, projections and partial sums between."""
    out, above = set(), None
    for row in plan.split("\n"):
        text = row.lstrip(" :+-*()0123456789")
        if text.startswith(exchange):
            above = True
        elif text.startswith(("SortMergeJoin", "Union", "HashAggregate(keys=[f_bill_id")):
            above = False
        elif "FileScan parquet" in text and above:
            out.add(re.search(r"spark_catalog\.tl_layout\.(\w+)|/(\w+)\]", text).group(1))
    return out


@needs_data
@pytest.mark.parametrize("report", [R.bill_relation_purchase, R.bill_relation_sale])
def test_chains_over_the_link_index(derived, layout, report, no_broadcast):
    stored, plain = report(layout, TEST_PERIOD), report(derived, TEST_PERIOD)
    plan = _plan(stored)
    assert "hashpartitioning(__id" not in re.sub(r"hashpartitioning\(__id#\d+L, __type#\d+, __salt.*", "", plan)
    joins = [r for r in plan.split("\n") if "SortMergeJoin [__id#" in r and "__salt" not in r]
    assert len(joins) == 1  # the chain's own join, on buckets
    assert "order_line" not in _exchanged_tables(plan)
    assert _rows(stored) == _rows(plain) and stored.columns == plain.columns


def test_index_with_hot_and_null_links(spark, tmp_path, no_broadcast):
    def bill(i, kind, use_id, use_type, origin="r"):
        return dict(bill_id=i, bill_type=kind, bill_code=f"B{i}", bill_date=d(5), bill_amount=i, qty=1, use_id=use_id,
                    use_bill_type=use_type, relation_from=origin)

    browse = [bill(1, 1101, 2, 1102), bill(2, 1102, 7, 0), bill(3, 1101, 0, 1102), bill(0, 1102, 8, 0),
              bill(4, 1101, -1, 1102), bill(5, 1101, None, 1102), bill(6, 1101, 2, None), bill(9, 1101, 99, 1102),
              bill(10, 1101, 2, 1104), bill(11, 1101, 2, 1102)]
    t = make_tables(spark, stock_bill_browse=browse, order_bill=[dict(bill_id=7, bill_date=d(1), bill_amount=3)],
                    order_line=[dict(bill_id=7, qty=2), dict(bill_id=7, qty=5)])
    write_copartitioned_tables(spark, t, str(tmp_path), "tl_links", buckets=3)
    stored = load_copartitioned_tables(spark, "tl_links")
    period = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    from tradelens.operators.chain import bill_chain

    assert LINK_INDEX in stored
    assert _rows(bill_chain(stored)) == _rows(bill_chain(t)) and bill_chain(t).count() == len(browse)
    assert _rows(R.bill_relation_purchase(stored, period)) == _rows(R.bill_relation_purchase(t, period))


# ------------------------------------------------------------------ month and bucket

@needs_data
def test_months_are_pruned_and_joins_need_no_exchange(spark, derived, layout, no_broadcast):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df = R.customer_summary(layout, TEST_PERIOD)
    plan = _plan(df)
    for table in ("stock_line", "pos_line", "pos_line_hist", "stock_bill", "pos_bill", "pos_bill_hist"):
        scans = [r for r in plan.split("\n") if f"tl_layout.{table}[" in r]
        assert scans and all(f"PartitionFilters: [isnotnull({MONTH}" in r and ">= 199701" in r for r in scans), table
    assert "hashpartitioning(bill_id" not in plan and "SortMergeJoin [bill_id" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert _rows(df) == _rows(R.customer_summary(derived, TEST_PERIOD))


@needs_data
def test_every_report_over_the_layout(derived, layout):
    for group in R.REPORT_GROUPS.values():
        for sheet, report in group:
            assert _rows(report(layout, TEST_PERIOD)) == _rows(report(derived, TEST_PERIOD)), sheet


def _moves(bills, lines):
    return dict(stock_bill=[dict(bill_id=i, bill_type=k, bill_date=date, use_id=0, party_id=10) for i, k, date in bills],
                stock_line=[line(i, g, q, q) for i, g, q in lines])


BILLS = [(1, 1102, d(3)), (2, 1204, d(20)), (3, 1102, d(5, month=2)), (4, 1104, d(7, month=3)), (5, 1102, None),
         (6, 1201, d(9))]
LINES = [(1, 1, 10), (1, 2, 5), (2, 1, 3), (3, 1, 7), (4, 2, 2), (5, 1, 100), (6, 1, 1), (77, 1, 9), (3, None, 4)]
# bill 3 moves to March, bill 2 is deleted with its line, line (1, 2) changes, bill 8 comes late to January
BILLS_LATER = [(1, 1102, d(3)), (3, 1102, d(5, month=3)), (4, 1104, d(7, month=3)), (5, 1102, None), (6, 1201, d(9)),
               (8, 1102, d(31))]
LINES_LATER = [(1, 1, 10), (1, 2, 6), (3, 1, 7), (4, 2, 2), (5, 1, 100), (6, 1, 1), (77, 1, 9), (3, None, 4), (8, 2, 11)]


def test_refresh_writes_changed_months_only(spark, tmp_path):
    before, after = (make_tables(spark, **_moves(*x)) for x in ((BILLS, LINES), (BILLS_LATER, LINES_LATER)))
    write_copartitioned_tables(spark, {n: before[n] for n in MONTHLY}, str(tmp_path), "tl_fresh", buckets=2)
    april = make_tables(spark, **_moves([*BILLS_LATER, (9, 1102, d(1, month=4))], LINES_LATER))
    for tables, months in ((after, {"stock_bill": [202401, 202402, 202403], "stock_line": [202401, 202402, 202403]}),
                           (after, {}), (april, {"stock_bill": [202404]})):
        done = refresh_months(spark, tables, "tl_fresh")
        assert {k: v for k, v in done.items() if v} == months
        stored = load_copartitioned_tables(spark, "tl_fresh", MONTHLY)
        for name in MONTHLY:
            whole = with_month(tables, name)
            assert _rows(stored[name].select(*whole.columns)) == _rows(whole), name


# ------------------------------------------------------------------ stock rollup

JAN = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))


def test_rollup_equals_the_recomputation(spark, tmp_path):
    before, after = (make_tables(spark, **_moves(*x)) for x in ((BILLS, LINES), (BILLS_LATER, LINES_LATER)))
    root = str(tmp_path)
    write_stock_rollup(before, root)
    assert _rows(import_by_goods(Tables({**before, ROLLUP: load_stock_rollup(before, root)}), JAN)) == _rows(
        import_by_goods(before, JAN))
    stale = sorted(r[MONTH] for r in stale_months(after, root).collect())
    assert stale == [202401, 202402, 202403]
    # open months are read from the lines, the others from the rollup
    opened = Tables({**after, ROLLUP: load_stock_rollup(after, root, stale)})
    assert _rows(net_stock_by_goods(opened)) == _rows(net_stock_by_goods(after))
    refresh_stock_rollup(after, root, stale)  # February lost its only bill
    assert stale_months(after, root).count() == 0
    assert read_stock_rollup(after, root).filter(F.col(MONTH) == 202402).count() == 0
    kept = Tables({**after, ROLLUP: load_stock_rollup(after, root)})
    assert _rows(import_by_goods(kept, JAN)) == _rows(import_by_goods(after, JAN))


@needs_data
def test_reports_over_the_rollup_read_open_months_only(spark, layout, derived, tmp_path):
    write_stock_rollup(layout, str(tmp_path))
    kept = Tables({**layout, ROLLUP: load_stock_rollup(layout, str(tmp_path), [199701])})
    for report in (R.product_sale, R.product_category_sale):
        assert _rows(report(kept, TEST_PERIOD)) == _rows(report(derived, TEST_PERIOD))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    scans = [r for r in _plan(R.product_sale(kept, TEST_PERIOD)).split("\n") if "tl_layout.stock_line[" in r]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert scans and all("199701" in r.split("PartitionFilters: ")[1].split("]")[0] for r in scans)


# ------------------------------------------------------------------ reduction before the shuffle

def test_may_match_keeps_every_match_and_drops_most_others(spark):
    fact = spark.range(20_000).select((F.col("id") - 5).alias("k"), (F.col("id") % 3).cast("int").alias("t")).unionByName(
        spark.createDataFrame([(None, 1), (7, None)], "k long, t int"))
    other = spark.range(0, 20_000, 97).select(F.col("id").alias("x"), (F.col("id") % 3).cast("int").alias("y"))
    got = may_match(fact, ["k", "t"], other, ["x", "y"])
    exact = fact.join(other, (fact.k == other.x) & (fact.t == other.y), "left_semi")
    assert exact.exceptAll(got).count() == 0
    assert exact.count() <= got.count() <= exact.count() + 40
    assert may_match(fact, ["k"], other.limit(0), ["x"]).count() == 0
    assert may_match(fact.limit(0), ["k"], other, ["x"]).count() == 0


@needs_data
def test_payments_shuffled_follow_the_period(spark, derived, tmp_path, no_broadcast):
    from tradelens.sources.tables import load_parquet_tables, write_parquet_tables

    write_parquet_tables(derived, str(tmp_path))
    t = load_parquet_tables(spark, str(tmp_path))
    a = R._receivables_in_period(t, TEST_PERIOD, detail=False)
    kept, paid = R._payments_of(t, a).pay_line, t.pay_line
    matching = paid.join(a, (paid.use_id == a.bill_id) & (paid.use_bill_type == a.bill_type), "left_semi").count()
    assert matching <= kept.count() <= matching + 5 and 5 * matching < paid.count()


# ------------------------------------------------------------------ atomic group

@needs_data
def test_a_failing_report_leaves_the_old_group_whole(spark, derived, tmp_path, monkeypatch):
    out = str(tmp_path)
    folder = write_report_bundle(spark, derived, "Sale_Report", TEST_PERIOD, out)
    name = os.path.basename(folder)

    def files():
        return sorted(os.path.join(p, f) for p, _, names in os.walk(folder) for f in names)

    manifest = {r.report: r for r in spark.read.json(f"{folder}/_manifest").collect()}
    for sheet, report in R.REPORT_GROUPS["Sale_Report"]:
        assert manifest[sheet].rows == spark.read.parquet(f"{folder}/{sheet}").count() == report(derived, TEST_PERIOD).count()
        assert manifest[sheet].part_files == sum(f.startswith("part-") for f in os.listdir(f"{folder}/{sheet}"))
    before = files()

    def broken(t, period, shared=None):
        return t.goods.select(F.raise_error(F.lit("third sheet")).alias("x"))

    sheets = R.REPORT_GROUPS["Sale_Report"]
    monkeypatch.setitem(bundle.REPORT_GROUPS, "Sale_Report", (*sheets[:2], ("Product_Never_Sold", broken)))
    with pytest.raises(Exception, match="third sheet"):
        write_report_bundle(spark, derived, "Sale_Report", TEST_PERIOD, out, max_parallel=1)
    assert files() == before and os.listdir(out) == [name]
    monkeypatch.setitem(bundle.REPORT_GROUPS, "Sale_Report", sheets)
    write_report_bundle(spark, derived, "Sale_Report", TEST_PERIOD, out)
    assert os.listdir(out) == [name] and files() != before


def test_repair_after_an_interrupted_switch(spark, tmp_path):
    def make(name, committed):
        (tmp_path / name / "Sheet").mkdir(parents=True)
        if committed:
            (tmp_path / name / "_manifest").mkdir()

    make(".G.old-1", True)  # stopped between the two renames: the staged group is whole
    make(".G.staged-1", True)
    repair_group(spark, str(tmp_path), "G")
    assert os.listdir(tmp_path) == ["G"] and (tmp_path / "G" / "_manifest").exists()
    make(".G.staged-2", False)  # stopped while writing
    repair_group(spark, str(tmp_path), "G")
    assert os.listdir(tmp_path) == ["G"]
