"""Per-goods and per-class sale summaries (B10, B11) and the shared pre-aggregates.

Sums distribute over joins, so the fact DataFrame is aggregated by its own
keys (goods id, customer id) *before* it meets a dimension: the join then
sees one row per key instead of one per sale line, map-side partial
aggregation absorbs hot keys, and the final regrouping by the visible
attributes (which decide the output grain) runs on dimension-sized data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradelens.functions import expressions as X
from tradelens.functions.period import Period
from tradelens.operators.facts import sale_facts
from tradelens.operators.lookup import lookup_join
from tradelens.sources.contract import Tables

SUM = "decimal(38,2)"
COST_AMOUNT = "decimal(38,6)"


def facts_in_period(t: Tables, period: Period) -> DataFrame:
    """The facts a report needs: one period, without the department."""
    return sale_facts(t, period, with_dept=False)


def sales_by_party_goods(facts: DataFrame) -> DataFrame:
    """Σ qty, Σ amount per (party_id, goods_id); nulls are ordinary groups."""
    return facts.groupBy("party_id", "goods_id").agg(
        F.sum("qty").cast(SUM).alias("qty"), F.sum("amount").cast(SUM).alias("amount"))


def sales_by_goods(facts: DataFrame) -> DataFrame:
    return facts.groupBy("goods_id").agg(
        F.sum("qty").cast(SUM).alias("qty"), F.sum("amount").cast(SUM).alias("amount"))


def product_sale_summary(t: Tables, period: Period, facts: DataFrame | None = None,
                         by_goods: DataFrame | None = None) -> DataFrame:
    """Per sold goods (id, code, name, cost, class) in the period.

    ``by_goods`` may be any pre-aggregate with ``goods_id, qty, amount``
    (e.g. the per-customer one regrouped), ``facts`` the period's facts.
    """
    if by_goods is None:
        by_goods = sales_by_goods(facts if facts is not None else facts_in_period(t, period))
    goods = t.goods.select("goods_id", "goods_code", "goods_name", "ref_cost", "class_id")
    joined = lookup_join(by_goods, goods, "goods_id", "inner")
    g = joined.groupBy("goods_name", "goods_code", "ref_cost", "goods_id", "class_id").agg(
        F.sum("amount").cast(SUM).alias("total_amount"),
        F.sum("qty").cast(SUM).alias("total_sale_quantity"))
    cost_amount = (F.col("ref_cost") * F.col("total_sale_quantity")).cast(COST_AMOUNT)
    profit = (F.col("total_amount") - cost_amount).cast(COST_AMOUNT)
    return g.select(
        "goods_id", F.col("goods_code").alias("product_code"), "class_id",
        F.col("goods_name").alias("product_name"), "total_amount",
        F.col("ref_cost").alias("reference_cost_price"),
        cost_amount.alias("reference_cost_amount"),
        profit.alias("reference_profit"),
        X.ratio_or_zero(profit, F.col("total_amount")).alias("reference_profit_rate"),
        "total_sale_quantity")


def class_sale_summary(t: Tables, period: Period, product_summary: DataFrame | None = None) -> DataFrame:
    """B10 regrouped by (class name, class code); unknown class → nulls."""
    b10 = product_summary if product_summary is not None else product_sale_summary(t, period)
    classes = t.goods_class.select("class_id", "class_code", "class_name")
    joined = lookup_join(b10, classes, "class_id", "left", spread=("goods_id",))
    return joined.groupBy("class_name", "class_code").agg(
        F.sum("total_amount").cast(SUM).alias("total_sale_amount"),
        F.sum("reference_cost_amount").cast(COST_AMOUNT).alias("total_cost_amount"),
        F.sum("total_sale_quantity").cast(SUM).alias("total_sale_quantity"))
