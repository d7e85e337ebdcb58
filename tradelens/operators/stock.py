"""Stock movement totals.

The source computes the import totals in two levels (by goods and document
type, then by goods) and joins period entries onto all-time totals. With
exact decimal sums both levels fold into one aggregation per goods:

* ``total_import``    Σ qty of 1102/1104 minus Σ qty of 1204, all time,
                      cancelled documents included;
* ``total_import_cp`` Σ qty of 1102 inside the period (NULL when none).

One join of lines to their (type-filtered) bills and one partial + final
aggregation keyed by goods; class totals re-aggregate the goods totals, so
the fact-grain join is never repeated. Tables with a stock rollup (``operators.rollup``)
are not read for the all-time totals at all; they are the sums of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradelens.functions import expressions as X
from tradelens.functions.period import Period, in_period
from tradelens.operators.facts import lines_in, lines_of
from tradelens.operators.lookup import lookup_join
from tradelens.operators.rollup import ROLLUP, totals_from_rollup
from tradelens.sources.contract import Tables

QTY_SUM = "decimal(38,2)"


def stock_movements(t: Tables) -> DataFrame:
    """Lines of stock-movement bills (1102, 1104, 1204) with type and date, all time."""
    bills = t.stock_bill.filter(F.col("bill_type").isin(*X.STOCK_MOVEMENT_TYPES)).select(
        "bill_id", "bill_type", "bill_date")
    lines = t.stock_line.select("bill_id", "goods_id", "qty")
    return lookup_join(lines, bills, "bill_id", "inner")


def net_stock_by_goods(t: Tables) -> DataFrame:
    """Net stock quantity per goods, all time."""
    if ROLLUP in t:
        return totals_from_rollup(t[ROLLUP])
    return stock_movements(t).groupBy("goods_id").agg(
        F.sum(X.stock_signed("qty", "bill_type")).cast(QTY_SUM).alias("total_import"))


def period_entry_by_goods(t: Tables, period: Period) -> DataFrame:
    """Σ qty of warehouse entries (1102 only) in the period, per goods."""
    bills = lines_in(t.stock_bill, period).filter(
        (F.col("bill_type") == X.WAREHOUSE_ENTRY) & in_period("bill_date", period)).select("bill_id")
    lines = lines_of(t.stock_line, bills, period).select("bill_id", "goods_id", "qty")
    entries = lookup_join(lines, bills, "bill_id", "inner")
    return entries.groupBy("goods_id").agg(F.sum("qty").cast(QTY_SUM).alias("total_import_cp"))


def import_by_goods(t: Tables, period: Period) -> DataFrame:
    """Both import totals per goods from one aggregation.

    In the two-level form period entries reach a goods row through an
    equality join on goods id, so the NULL-goods row never gets one; kept.
    """
    if ROLLUP in t:
        entries = period_entry_by_goods(t, period)
        return net_stock_by_goods(t).join(entries, "goods_id", "left").select("goods_id", "total_import_cp", "total_import")
    in_cp = (F.col("bill_type") == X.WAREHOUSE_ENTRY) & in_period("bill_date", period)
    g = stock_movements(t).groupBy("goods_id").agg(
        F.sum(F.when(in_cp, F.col("qty"))).cast(QTY_SUM).alias("total_import_cp"),
        F.sum(X.stock_signed("qty", "bill_type")).cast(QTY_SUM).alias("total_import"))
    return g.select("goods_id",
                    F.when(F.col("goods_id").isNotNull(), F.col("total_import_cp"))
                    .cast(QTY_SUM).alias("total_import_cp"),
                    "total_import")


def net_stock_by_class(t: Tables, by_goods: DataFrame | None = None) -> DataFrame:
    """Net stock per (class code, class name); goods without a class → nulls.

    Reuses the per-goods totals (``by_goods``, B7 or B9) when given.
    """
    goods_totals = (by_goods if by_goods is not None else net_stock_by_goods(t)).select(
        "goods_id", "total_import")
    goods = t.goods.select("goods_id", "class_id")
    with_goods = lookup_join(goods_totals, goods, "goods_id", "inner")
    with_class = lookup_join(with_goods, t.goods_class.select("class_id", "class_code", "class_name"),
                             "class_id", "left", spread=("goods_id",))
    return with_class.groupBy("class_code", "class_name").agg(
        F.sum("total_import").cast(QTY_SUM).alias("total_import"))
