"""Document chains: the stock-bill browse view, type names (B14), chains.

A chain links a bill ``a`` to the bill ``b`` it was created from
(``a.use_id = b.bill_id AND a.use_bill_type = b.bill_type``) and ``b`` to the
order bill ``f`` named by ``b.use_id`` (type not checked). Order quantities
are summed per order bill *before* the join, so the fact-grain order lines
are reduced by a partial + final aggregation instead of being joined row by
row into the chain.

Where the tables have a link index (``sources.copartitioned``), ``a`` is read by its
link and ``b`` by its id, bucketed alike, and meet without an exchange. Otherwise the
side without a period is reduced to rows that may match before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradelens.operators.lookup import lookup_join
from tradelens.operators.reduce import may_match
from tradelens.sources.contract import LINK_INDEX, Tables, conform


def bill_browse(bills_with_links: DataFrame, stock_line: DataFrame) -> DataFrame:
    """Browse view over stock bills: the bill, its link columns and line qty total."""
    qty = stock_line.groupBy("bill_id").agg(F.sum("qty").alias("qty"))
    return conform(bills_with_links.join(qty, "bill_id", "left"), "stock_bill_browse")


def bill_type_name_en(t: Tables) -> DataFrame:
    """``type_id → english_name``; null unless the type is in both tables."""
    en = t.bill_type_en.select("type_id", "english_name")
    # the English-name table is a fixed literal list of eight rows
    return lookup_join(t.bill_type.select("type_id"), en, "type_id", "left", broadcast=True)


def order_qty_by_bill(order_line: DataFrame) -> DataFrame:
    """Σ order-line qty per order bill (pre-aggregated before any join)."""
    return order_line.groupBy("bill_id").agg(F.sum("qty").cast("decimal(38,2)").alias("order_qty"))


# a bill made from nothing links to 0, a cancelled one to -1: the commonest link values
HOT_LINKS = (0, -1)

_ORDER_COLUMNS = ("f_bill_id", "f_bill_date", "f_bill_amount")


def linked_bills(t: Tables) -> DataFrame:
    """The browse view as the linking side of a chain: by link where the tables have that index."""
    return t.get(LINK_INDEX, t.stock_bill_browse)


_LINK = ["__id", "__type"]


def _follow_links(t: Tables, a: DataFrame, b: DataFrame, b_is_larger: bool | None) -> DataFrame:
    """``a ⟕ b`` on the link; ``a`` and ``b`` have it as ``__id`` and ``__type``."""
    if LINK_INDEX not in t:
        if b_is_larger:
            b = may_match(b, _LINK, a, _LINK)
        return lookup_join(a, b, _LINK, spread=("a_bill_id",), hot=HOT_LINKS)
    # buckets hold ordinary links; the commonest values and NULLs are few on b's side and are dealt by salt
    usual = F.coalesce(~F.col("__id").isin(*HOT_LINKS), F.lit(False)) & F.col("__type").isNotNull()
    return a.filter(usual).join(b, _LINK, "left").unionByName(
        lookup_join(a.filter(~usual), b.filter(F.col("__id").isin(*HOT_LINKS)), _LINK, spread=("a_bill_id",),
                    hot=HOT_LINKS))


def bill_chain(t: Tables, a: DataFrame | None = None, b: DataFrame | None = None,
               b_is_larger: bool | None = None) -> DataFrame:
    """Chain rows ``a → b → f`` with English type names and order qty.

    ``a`` / ``b`` default to the whole browse view; reports pass them
    pre-filtered so the self join only sees the bills of interest.
    ``b_is_larger`` says that ``a`` is one period's and ``b`` is not. Output
    columns are those of the browse view prefixed ``a_`` and ``b_``, then the
    order's (``f_``), ``name_a`` / ``name_b`` / ``name_link`` (the English names
    of ``a.bill_type``, ``b.bill_type`` and ``b.use_bill_type``) and
    ``order_qty``.
    """
    browse = t.stock_bill_browse
    a = linked_bills(t) if a is None else a
    b = browse if b is None else b
    a_cols = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns],
                      F.col("use_id").alias("__id"), F.col("use_bill_type").alias("__type"))
    b_cols = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns],
                      F.col("bill_id").alias("__id"), F.col("bill_type").alias("__type"))
    ab = _follow_links(t, a_cols, b_cols, b_is_larger).drop(*_LINK)
    # f is looked up by b.use_id; f_bill_id comes from the order side (NULL if none).
    # One row per order bill with its summed lines, joined before it meets the chain.
    qty = order_qty_by_bill(t.order_line)
    orders = t.order_bill.select("bill_id", "bill_date", "bill_amount").join(qty, "bill_id", "left").select(
        F.col("bill_id").alias("__order"), F.col("bill_id").alias("f_bill_id"), F.col("bill_date").alias("f_bill_date"),
        F.col("bill_amount").alias("f_bill_amount"), "order_qty")
    chain = lookup_join(ab.withColumn("__order", F.col("b_use_id")), orders, "__order",
                        spread=("a_bill_id",), hot=HOT_LINKS)
    names = bill_type_name_en(t)
    for src, out in (("a_bill_type", "name_a"), ("b_bill_type", "name_b"),
                     ("b_use_bill_type", "name_link")):
        lookup = names.select(F.col("type_id").alias(src), F.col("english_name").alias(out))
        chain = lookup_join(chain, lookup, src, spread=("a_bill_id",))
    return chain.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns], *_ORDER_COLUMNS,
                        "name_a", "name_b", "name_link", "order_qty")
