"""Registered queries vs their DuckDB statements on the sf0.001 test tables,
plus invariants between reports and plan-shape checks."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as E
from tradelens.functions.period import TEST_PERIOD
from tradelens.oracle import statements
from tradelens.plans import reports as R
from tradelens.plans.bundle import run_group, staged, write_report_bundle
from tradelens.plans.catalog import QUERIES, STORED_FIRST
from tradelens.plans.reports import SharedPlans
from tradelens.sources.fixtures import derive_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")

VIEWS = ("region nation customer supplier part orders lineitem events").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{SF}/{v}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


def _multiset(cols, data):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(statements()))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(statements()[name])
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    assert sdf.columns == d_cols
    assert _multiset(sdf.columns, s_rows) == _multiset(d_cols, d_rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(statements())
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["product_code", "product_name", "total_amount"]


def test_invariants(spark):
    t = derive_tables(spark, SF)
    s = SharedPlans(t, TEST_PERIOD)
    by_r6 = {(r["customer_name"], r["product_code"]): r["total_amount"]
             for r in R.customer_product(t, TEST_PERIOD, s).collect()}
    by_r9: dict = {}
    for r in R.customer_detail(t, TEST_PERIOD, s).collect():
        key = (r["customer_name"], r["product_code"])
        by_r9[key] = by_r9.get(key, 0) + r["amount"]
    assert by_r6 == by_r9
    total_r8 = sum(r["total_amount"] or 0 for r in R.customer_summary(t, TEST_PERIOD, s).collect())
    total_r6 = sum(by_r6.values())
    adjustments = sum(r["amount"] for r in s.facts().filter("goods_id = 0").collect())
    assert total_r8 - total_r6 == adjustments


def test_bundle_shares_staged_facts(spark, tmp_path):
    t = derive_tables(spark, SF)
    shared = SharedPlans(t, TEST_PERIOD, stage=staged(spark, "test"))
    reports = run_group(t, "Customer_Report", TEST_PERIOD, shared)
    assert list(reports) == ["Customer_Product", "Customer_Product_Category", "Customer_Summary",
                             "Customer_Detail", "Customer_Info"]
    direct = R.customer_summary(t, TEST_PERIOD).collect()
    assert sorted(map(tuple, reports["Customer_Summary"].collect())) == sorted(map(tuple, direct))
    with pytest.raises(KeyError):
        run_group(t, "No_Such_Report", TEST_PERIOD)
    folder = write_report_bundle(spark, t, "Account_Receivable_Report", TEST_PERIOD, str(tmp_path))
    assert folder.endswith("Account_Receivable_Report_1997-01-01__1997-01-20")
    back = spark.read.parquet(f"{folder}/Receivable_Summary")
    assert back.count() == R.receivable_summary(t, TEST_PERIOD).count()
    assert spark.read.json(f"{folder}/_headers").count() == 9 + 12


def test_period_reaches_the_scan_and_no_cartesian(spark):
    t = derive_tables(spark, SF)
    for fn in (R.customer_summary, R.product_sale, R.receivable_summary, R.bill_relation_sale):
        df = fn(t, TEST_PERIOD)
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", [
    "bill_relation_purchase", "bill_relation_sale", "product_sale", "product_category_sale",
    "customer_product", "customer_summary", "customer_detail", "receivable_summary",
    "receivable_detail", "null_aware_anti"])
def test_shuffle_paths_match_oracle(spark, duck, no_broadcast, name):
    sdf = QUERIES[name](spark, SF)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    rel = duck.execute(statements()[name])
    d_cols = [c[0] for c in rel.description]
    assert _multiset(sdf.columns, [tuple(r) for r in sdf.collect()]) == _multiset(d_cols, rel.fetchall())


@pytest.fixture(scope="module")
def jobs(spark):
    """How many Spark jobs started since the last call."""
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    seen = set()

    def count() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        now = set(tracker.getJobIdsForGroup(None))
        new = now - seen
        seen.update(now)
        return len(new)

    count()
    return count


def test_building_a_plan_starts_no_job(spark, jobs):
    QUERIES["product_sale"](spark, SF)  # the raw tables' schemas are read once
    for name, query in QUERIES.items():
        if name in STORED_FIRST:
            continue
        jobs()
        query(spark, SF)
        assert jobs() == 0, name


def _joins(df) -> list[str]:
    """Logical joins, in order."""
    import re

    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", line.strip(" :+-")) for line in text.split("\n") if "Join " in line]


def test_one_plan_at_every_size(spark):
    small, large = derive_tables(spark, SF), derive_tables(spark, "/root/testdata/sf0.01")
    for _, reports in R.REPORT_GROUPS.items():
        for name, fn in reports:
            assert _joins(fn(small, TEST_PERIOD)) == _joins(fn(large, TEST_PERIOD)), name


def test_only_literal_lists_are_broadcast_by_hint(spark):
    t = derive_tables(spark, SF)
    for _, reports in R.REPORT_GROUPS.items():
        for name, fn in reports:
            plan = fn(t, TEST_PERIOD)._jdf.queryExecution().analyzed().toString()
            assert plan.count("ResolvedHint (strategy=broadcast)") <= (3 if name.startswith("Bill_") else 1), name


def test_monthly_lines_are_pruned_and_give_the_same_reports(spark, tmp_path):
    from tradelens.sources.tables import load_parquet_tables, write_monthly_tables

    t = derive_tables(spark, SF)
    write_monthly_tables(t, str(tmp_path))
    monthly = load_parquet_tables(spark, str(tmp_path))
    for fn in (R.product_sale, R.product_category_sale, R.customer_product, R.customer_product_category,
               R.customer_summary, R.customer_detail):
        df = fn(monthly, TEST_PERIOD)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bill_month" in plan, fn.__name__
        assert "GreaterThanOrEqual(bill_date,1997-01-01" in plan, fn.__name__  # headers: pushed to the scan
        assert _multiset(df.columns, df.collect()) == _multiset(df.columns, fn(t, TEST_PERIOD).collect())


# ---- order of the written reports: read back file by file

ORDERS = {
    "bill_relation_purchase": [("bill_date_1", False)], "bill_relation_sale": [("bill_date_1", False)],
    "product_sale": [("total_amount", False)], "product_never_sold": [("code", True)],
    "customer_product": [("customer_name", True), ("total_amount", False)],
    "customer_product_category": [("total_amount", False)], "customer_summary": [("total_amount", False)],
    "customer_detail": [("customer_name", True), ("bill_date", True), ("amount", False)],
    "customer_info": [("name", True)],
}


def _written(spark, df, path) -> list:
    """Rows in the order of the part files."""
    df.write.mode("overwrite").parquet(path)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [r for f in files for r in spark.read.parquet(f"{path}/{f}").coalesce(1).collect()]


def _cash_first(key):
    """The source sorts by the name it stores, where a cash sale has none: NULL comes first."""
    return (0, "") if key in (None, "General(Cash)") else (1, key)


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_written_order(spark, tmp_path, name):
    rows = _written(spark, QUERIES[name](spark, SF), str(tmp_path / name))
    assert rows

    def before(a, b) -> bool:
        for column, ascending in ORDERS[name]:
            x, y = (_cash_first(r[column]) if column == "customer_name" else
                    (r[column] is not None, r[column]) for r in (a, b))
            if x != y:
                return (x < y) == ascending
        return True

    assert all(before(a, b) for a, b in zip(rows, rows[1:]))
    if name in ("customer_product", "customer_detail"):
        assert rows[0]["customer_name"] == "General(Cash)" and rows[-1]["customer_name"] != "General(Cash)"


@pytest.mark.parametrize("name", ["receivable_summary", "receivable_detail"])
def test_written_order_of_receivables(spark, tmp_path, name):
    """Live before cancelled (detail: by the raw link), then latest first: by keys that aren't shown."""
    rows = _written(spark, QUERIES[name](spark, SF), str(tmp_path / name))
    canceled = [r["is_bill_canceled"] == "Canceled" for r in rows]
    assert rows and canceled == sorted(canceled)
    code = "bill_code" if name == "receivable_summary" else "bill_code_1"
    date = code.replace("code", "date")
    links = {r.bill_code: r.use_id for r in derive_tables(spark, SF).stock_bill.select("bill_code", "use_id").collect()}

    def status(r):
        link = links.get(r[code], 0)
        return link if name == "receivable_detail" else (0 if link is not None and link >= 0 else -1)

    keys = [(-status(r), -r[date].toordinal()) for r in rows]
    assert keys == sorted(keys)
