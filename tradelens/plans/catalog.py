"""Registered queries: every report and building block over the test tables.

Each entry is ``(spark, sf_dir) -> DataFrame``: the contract tables are
derived from ``sf_dir`` (whole tables) and the query runs for the test period.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelens.functions.period import TEST_PERIOD, in_period, in_period_by_day
from tradelens.operators import chain, facts, sales, stock
from tradelens.operators.anti import not_in
from tradelens.operators.lookup import lookup_join
from tradelens.operators.rollup import ROLLUP, load_stock_rollup, write_stock_rollup
from tradelens.plans import reports as R
from tradelens.plans.bundle import column_layout_profile, render_report
from tradelens.session import scratch_path
from tradelens.sources.contract import LINK_INDEX, Tables
from tradelens.sources.copartitioned import buckets_for, load_copartitioned_tables, write_copartitioned_tables
from tradelens.sources.fixtures import derive_tables

Query = Callable[[SparkSession, str], DataFrame]


_derived: dict[tuple[int, str], tuple[SparkSession, Tables]] = {}


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived contract tables of ``sf_dir`` (lazy DataFrames), kept per
    session so building a query analyses them once."""
    key = (id(spark), sf_dir)
    hit = _derived.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, derive_tables(spark, sf_dir))
        _derived[key] = hit
    return hit[1]


def _rounded(df: DataFrame) -> DataFrame:
    """Ratios to six places, for comparison between engines; the reports don't round."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _report(fn) -> Query:
    return lambda spark, sf_dir: _rounded(fn(_tables(spark, sf_dir), TEST_PERIOD))


def _block(fn) -> Query:
    return lambda spark, sf_dir: fn(_tables(spark, sf_dir))


def _periodic(fn) -> Query:
    return lambda spark, sf_dir: _rounded(fn(_tables(spark, sf_dir), TEST_PERIOD))


def _null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 on derived data: goods codes with injected NULL probes, NOT IN the
    codes of goods sold in the period."""
    t = _tables(spark, sf_dir)
    probe = t.goods.select("goods_id", F.when(F.col("goods_id") % 7 == 0, F.lit(None))
                           .otherwise(F.col("goods_code")).alias("probe_code"))
    sold = sales.facts_in_period(t, TEST_PERIOD).select("goods_id").join(
        t.goods.select("goods_id", "goods_code"), "goods_id")
    return not_in(probe, "probe_code", sold, "goods_code")


def _bill_type_names_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14 applied to the document types that occur in the stock bills: the
    distinct types (partial + final aggregation over the whole bill table)
    with their English name (NULL unless the type is in both type tables)."""
    t = _tables(spark, sf_dir)
    used = t.stock_bill.select(F.col("bill_type").alias("type_id")).distinct()
    return lookup_join(used, chain.bill_type_name_en(t), "type_id", "left")


def _period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return t.stock_bill.filter(in_period("bill_date", TEST_PERIOD))


def _period_filter_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return facts.receivables(t).filter(in_period_by_day("full_bill_date", TEST_PERIOD))


def _rendered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_report(R.customer_detail(_tables(spark, sf_dir), TEST_PERIOD))


def _layout_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_layout_profile(_rounded(R.product_sale(_tables(spark, sf_dir), TEST_PERIOD)))


def _over_layout(names: tuple[str, ...], fn, *, index: bool = False) -> Query:
    """A report over the tables ``names`` stored by month and bucket (with the link index)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        root = scratch_path(spark, "copartitioned")
        database = f"tradelens_{root.rsplit('-', 1)[-1]}"
        shown = {n: t[n] for n in names}
        write_copartitioned_tables(spark, shown, root, database, buckets=buckets_for(shown))
        stored = load_copartitioned_tables(spark, database, (*names, *([LINK_INDEX] if index else [])))
        return _rounded(fn(Tables({**t, **stored}), TEST_PERIOD))
    return run


def _over_rollup(fn) -> Query:
    """A report whose all-time stock comes from the maintained totals, the period's months left open."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        root = scratch_path(spark, "stock-rollup")
        write_stock_rollup(t, root)
        open_months = sorted({d.year * 100 + d.month for d in (TEST_PERIOD.start_ts, TEST_PERIOD.end_inclusive_ts)})
        return _rounded(fn(Tables({**t, ROLLUP: load_stock_rollup(t, root, open_months)}), TEST_PERIOD))
    return run


_CHAIN_TABLES = ("stock_bill_browse", "order_bill", "order_line")
_SALE_TABLES = ("stock_bill", "stock_line", "pos_bill", "pos_line", "pos_bill_hist", "pos_line_hist")

QUERIES: dict[str, Query] = {
    # reports R1-R12
    "bill_relation_purchase": _report(R.bill_relation_purchase),
    "bill_relation_sale": _report(R.bill_relation_sale),
    "product_sale": _report(R.product_sale),
    "product_category_sale": _report(R.product_category_sale),
    "product_never_sold": _report(R.product_never_sold),
    "customer_product": _report(R.customer_product),
    "customer_product_category": _report(R.customer_product_category),
    "customer_summary": _report(R.customer_summary),
    "customer_detail": _report(R.customer_detail),
    "customer_info": _report(R.customer_info),
    "receivable_summary": _report(R.receivable_summary),
    "receivable_detail": _report(R.receivable_detail),
    # building blocks B1-B16
    "stock_sale_lines": _block(facts.stock_sale_lines),
    "adjustment_lines": _block(facts.adjustment_lines),
    "pos_open_lines": _block(facts.pos_open_lines),
    "pos_hist_lines": _block(facts.pos_hist_lines),
    "pos_lines": _block(facts.pos_lines),
    "sale_facts": _block(facts.sale_facts),
    "net_stock_by_goods": _block(stock.net_stock_by_goods),
    "period_entry_by_goods": _periodic(stock.period_entry_by_goods),
    "import_by_goods": _periodic(stock.import_by_goods),
    "product_sale_summary": _periodic(sales.product_sale_summary),
    "class_sale_summary": _periodic(sales.class_sale_summary),
    "net_stock_by_class": _block(stock.net_stock_by_class),
    "bill_chain": _block(chain.bill_chain),
    "bill_type_name_en": _bill_type_names_used,
    "receivables": _block(facts.receivables),
    "settlements": lambda spark, sf_dir: facts.settlements(_tables(spark, sf_dir), live_only=False),
    # stored layouts and maintained totals
    "bill_relation_purchase_indexed": _over_layout(_CHAIN_TABLES, R.bill_relation_purchase, index=True),
    "bill_relation_sale_indexed": _over_layout(_CHAIN_TABLES, R.bill_relation_sale, index=True),
    "customer_summary_copartitioned": _over_layout(_SALE_TABLES, R.customer_summary),
    "product_sale_rollup": _over_rollup(R.product_sale),
    "product_category_sale_rollup": _over_rollup(R.product_category_sale),
    # predicates, joins and outputs
    "period_filter": _period_filter,
    "period_filter_day": _period_filter_day,
    "null_aware_anti": _null_aware_anti,
    "rendered_report": _rendered_report,
    "column_layout_profile": _layout_profile,
}

#: Queries that first store their tables or totals (jobs by nature) and then read them.
STORED_FIRST = ("bill_relation_purchase_indexed", "bill_relation_sale_indexed", "customer_summary_copartitioned",
                "product_sale_rollup", "product_category_sale_rollup")
