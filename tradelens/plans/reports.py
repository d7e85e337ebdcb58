"""The twelve reports (R1-R12) as DataFrame plans.

Each report is ``report(t, period, shared=None) -> DataFrame``. ``shared``
(a :class:`SharedPlans`) lets a bundle compute the period's sale facts and
their pre-aggregates once and reuse them across reports; without it every
report builds its own plan from the tables.

Output grain is part of the contract: reports group by the visible
attributes exactly as the source system does (names, codes, prices), so two
customers with one name merge and equal-looking document chains collapse.
Ids only appear as grouping keys where the source uses them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tradelens.functions import expressions as X
from tradelens.functions.period import Period, in_period
from tradelens.operators.anti import not_in
from tradelens.operators.chain import bill_chain, linked_bills
from tradelens.operators.facts import receivables, settlements
from tradelens.operators.lookup import left_join_split_hot_right, lookup_join
from tradelens.operators.reduce import may_match
from tradelens.operators.sales import (
    SUM, class_sale_summary, facts_in_period, product_sale_summary, sales_by_goods,
    sales_by_party_goods)
from tradelens.operators.stock import import_by_goods, net_stock_by_class
from tradelens.sources.contract import LINK_INDEX, Tables


class SharedPlans:
    """Sub-plans shared by several reports of one period.

    ``stage`` (optional) materialises a shared DataFrame — the bundle passes
    a function that writes it to the shared checkpoint folder and reads it
    back, so later reports start from stored data and survive executor loss.
    """

    def __init__(self, t: Tables, period: Period,
                 stage: Callable[[DataFrame, str], DataFrame] | None = None):
        self.t, self.period, self._stage = t, period, stage
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._cache:
            df = build()
            self._cache[name] = self._stage(df, name) if self._stage else df
        return self._cache[name]

    def release(self) -> None:
        """Drop cached shared pieces and delete written ones."""
        for df in self._cache.values():
            if df.is_cached:
                df.unpersist()
        self._cache.clear()
        if hasattr(self._stage, "release"):
            self._stage.release()

    def facts(self) -> DataFrame:
        """B6 restricted to the period (F1)."""
        return self._get("facts", lambda: facts_in_period(self.t, self.period))

    def by_party_goods(self) -> DataFrame:
        return self._get("by_party_goods", lambda: sales_by_party_goods(self.facts()))

    def product_summary(self) -> DataFrame:
        return self._get("product_summary", lambda: product_sale_summary(
            self.t, self.period, by_goods=sales_by_goods(self.facts())))

    def by_party(self) -> DataFrame:
        """Σ qty, Σ amount per party: from the staged (party, goods) totals in a
        bundle, straight from the facts (one aggregation) otherwise."""
        source = self.by_party_goods() if self._stage else self.facts()
        return source.groupBy("party_id").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"))

    def imports(self) -> DataFrame:
        return self._get("imports", lambda: import_by_goods(self.t, self.period))


def _shared(t: Tables, period: Period, shared: SharedPlans | None) -> SharedPlans:
    return shared if shared is not None else SharedPlans(t, period)


# ------------------------------------------------------------ Bill_Report

_CHAIN_KEYS = ("f_bill_id", "name_a", "a_bill_code", "a_qty", "a_bill_amount", "a_bill_date",
               "name_b", "b_bill_code", "b_bill_date", "b_qty", "b_bill_amount",
               "name_link", "b_relation_from", "f_bill_date", "f_bill_amount")


def _chain_report(t: Tables, a: DataFrame, b: DataFrame, with_amount_label: bool, b_is_larger: bool | None = None) -> DataFrame:
    chain = bill_chain(t, a, b.filter(F.col("relation_from").isNotNull()), b_is_larger)
    chain = chain.filter(F.col("b_relation_from").isNotNull())
    g = chain.groupBy(*_CHAIN_KEYS).agg(F.sum("order_qty").cast(SUM).alias("quantity_3"))
    cols = [
        F.col("name_a").alias("bill_name_1"), F.col("a_bill_code").alias("bill_code_1"),
        F.lit(X.QTY_LABEL).alias("qty_label_1"), F.col("a_qty").alias("quantity_1"),
        F.col("a_bill_amount").alias("bill_amount_1"), F.col("a_bill_date").alias("bill_date_1"),
        F.col("name_b").alias("bill_name_2"), F.col("b_bill_code").alias("bill_code_2"),
        F.col("b_bill_date").alias("bill_date_2"), F.lit(X.QTY_LABEL).alias("qty_label_2"),
        F.col("b_qty").alias("quantity_2"), F.col("b_bill_amount").alias("bill_amount_2"),
        F.col("name_link").alias("bill_name_3"), F.col("b_relation_from").alias("bill_code_3"),
        F.col("f_bill_date").alias("bill_date_3"), F.lit(X.QTY_LABEL).alias("qty_label_3"),
        "quantity_3",
    ]
    if with_amount_label:
        cols.append(F.lit(X.AMT_LABEL).alias("amt_label_3"))
    cols.append(F.col("f_bill_amount").alias("bill_amount_3"))
    return g.orderBy(F.col("a_bill_date").desc()).select(*cols)


def bill_relation_purchase(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Purchase invoices in the period → the bill they came from → its order."""
    a = linked_bills(t).filter((F.col("bill_type") == X.PURCHASE_INVOICE) & in_period("bill_date", period))
    return _chain_report(t, a, t.stock_bill_browse, with_amount_label=False, b_is_larger=True)


def bill_relation_sale(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """R2: any bill → a sale invoice dated in the period → its order."""
    browse = t.stock_bill_browse
    b = browse.filter((F.col("bill_type") == X.SALE_INVOICE) & in_period("bill_date", period))
    # the chain joins a.use_bill_type = b.bill_type, so only links to sale invoices can match
    a = linked_bills(t).filter(F.col("use_bill_type") == X.SALE_INVOICE)
    if LINK_INDEX not in t:
        # only chains with a bill b are shown (its relation_from is set), so a may be reduced like an inner side
        a = may_match(a, ["use_id", "use_bill_type"], b, ["bill_id", "bill_type"])
    return _chain_report(t, a, b, with_amount_label=True)


# ------------------------------------------------------------ Sale_Report

def product_sale(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Per sold goods — amount, cost, profit, period entries, imports, move rate."""
    s = _shared(t, period, shared)
    joined = s.product_summary().join(s.imports(), "goods_id", "left")
    return joined.orderBy(F.col("total_amount").desc()).select(
        "product_code", "product_name", "total_amount", "reference_cost_price",
        "reference_cost_amount", "reference_profit", "reference_profit_rate",
        F.col("total_import_cp").alias("total_wareentry_quantity_cp"),
        "total_sale_quantity",
        F.col("total_import").alias("total_import_quantity"),
        X.ratio_or_null("total_sale_quantity", "total_import").alias("move_rate"))


def product_category_sale(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Per class — sale totals joined to net stock on the class code only."""
    s = _shared(t, period, shared)
    sales = class_sale_summary(t, period, s.product_summary())
    stock = net_stock_by_class(t, s.imports()).select(
        F.col("class_code").alias("i_class_code"), F.col("total_import"))
    joined = sales.join(stock, sales["class_code"] == stock["i_class_code"], "left")
    return joined.select(
        F.col("class_code").alias("category_code"), F.col("class_name").alias("category_name"),
        "total_sale_amount", "total_cost_amount", "total_sale_quantity",
        F.col("total_import").alias("total_import_quantity"),
        X.ratio_or_null("total_sale_quantity", "total_import").alias("move_rate"))


def product_never_sold(t: Tables, period: Period | None = None,
                       shared: SharedPlans | None = None) -> DataFrame:
    """Goods whose code is NOT IN the sold-goods codes (SQL null semantics)."""
    rest = not_in(t.goods, "goods_code", t.sold_goods, "goods_code")
    return rest.orderBy("goods_code").select(
        F.col("goods_code").alias("code"), F.col("goods_name").alias("name"),
        F.col("model").alias("factory_code"), F.col("sale_price"),
        F.col("ref_cost").alias("cost_price"))


# ------------------------------------------------------------ Customer_Report

def _party_names(t: Tables) -> DataFrame:
    return t.party.select("party_id", "name")


def customer_product(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Per (customer name, goods name, goods code)."""
    s = _shared(t, period, shared)
    goods = t.goods.select("goods_id", "goods_code", "goods_name")
    x = lookup_join(s.by_party_goods(), goods, "goods_id", "inner")
    x = lookup_join(x, _party_names(t), "party_id", "left", spread=("goods_id",))
    g = x.groupBy("name", "goods_name", "goods_code").agg(
        F.sum("qty").cast(SUM).alias("total_quantity"), F.sum("amount").cast(SUM).alias("total_amount"))
    return g.orderBy(F.col("name").asc(), F.col("total_amount").desc()).select(
        X.customer_name("name").alias("customer_name"), F.col("goods_code").alias("product_code"),
        F.col("goods_name").alias("product_name"), "total_quantity", "total_amount")


def customer_product_category(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Per (customer name, class name)."""
    s = _shared(t, period, shared)
    x = lookup_join(s.by_party_goods(), _party_names(t), "party_id", "left", spread=("goods_id",))
    x = lookup_join(x, t.goods.select("goods_id", "class_id"), "goods_id", "inner")
    x = lookup_join(x, t.goods_class.select("class_id", "class_name"), "class_id", "left", spread=("goods_id",))
    g = x.groupBy("name", "class_name").agg(
        F.sum("qty").cast(SUM).alias("total_quantity"), F.sum("amount").cast(SUM).alias("total_amount"))
    return g.orderBy(F.col("total_amount").desc()).select(
        X.customer_name("name").alias("customer_name"), F.col("class_name").alias("category_name"),
        "total_quantity", "total_amount")


def customer_summary(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Per customer name, over all facts (adjustments and line-less bills too)."""
    s = _shared(t, period, shared)
    by_party = s.by_party()
    x = lookup_join(by_party, _party_names(t), "party_id", "left")
    g = x.groupBy("name").agg(
        F.sum("qty").cast(SUM).alias("total_quantity"), F.sum("amount").cast(SUM).alias("total_amount"))
    return g.orderBy(F.col("total_amount").desc()).select(
        X.customer_name("name").alias("customer_name"), "total_quantity", "total_amount")


def customer_detail(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Sale lines of real goods with the customer name (fact grain)."""
    s = _shared(t, period, shared)
    facts = s.facts().select("party_id", "goods_id", "bill_date", "qty", "amount", "disc_rate")
    goods = t.goods.select("goods_id", "goods_code", "goods_name")
    x = lookup_join(facts, goods, "goods_id", "inner")
    x = lookup_join(x, _party_names(t), "party_id", "left", spread=("bill_date", "amount"))
    return x.orderBy(F.col("name").asc(), F.col("bill_date").asc(), F.col("amount").desc()).select(
        X.customer_name("name").alias("customer_name"), "bill_date",
        F.col("goods_code").alias("product_code"), F.col("goods_name").alias("product_name"),
        F.col("qty").alias("quantity"), "amount", F.col("disc_rate").alias("discount_rate"))


CUSTOMER_INFO_COLUMNS = (("code", "code"), ("name", "name"), ("address", "address"),
                         ("postcode", "postcode"), ("contact", "contact"), ("tele", "tel"),
                         ("mobile", "mobile"), ("fax", "fax"), ("email", "email"),
                         ("website", "website"), ("country", "country"), ("company", "company"),
                         ("city", "city"), ("create_date", "create_date"))


def customer_info(t: Tables, period: Period | None = None, shared: SharedPlans | None = None) -> DataFrame:
    """Active customers with their contact columns (no period)."""
    p = t.party.filter((F.col("function_id") == X.CUSTOMER_FUNCTION) & (F.col("no_use") == 0))
    return p.orderBy("name").select(*[F.col(src).alias(dst) for src, dst in CUSTOMER_INFO_COLUMNS])


# ------------------------------------------------------------ Account_Receivable_Report

def _receivables_in_period(t: Tables, period: Period, detail: bool) -> DataFrame:
    return receivables(t, detail=detail, period=period)


def _payments_of(t: Tables, receivables_shown: DataFrame) -> Tables:
    """The tables with the payment lines that may settle one of the receivables: what is shuffled of
    the payments follows the period and not their history."""
    lines = may_match(t.pay_line, ["use_id", "use_bill_type"], receivables_shown, ["bill_id", "bill_type"])
    return Tables({**t, "pay_line": lines})


def _type_names(t: Tables, as_key: str, as_name: str) -> DataFrame:
    return t.bill_type.select(F.col("type_id").alias(as_key), F.col("name").alias(as_name))


def receivable_summary(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """Receivables settled by live payment bills, per visible receivable and
    per payment-bill status; receivables with no live payment drop out. The
    payment bill's type name isn't shown, so it isn't joined (type ids are unique)."""
    a = _receivables_in_period(t, period, detail=False)
    pays = settlements(_payments_of(t, a), live_only=True, receivable_types_only=True).filter(F.col("pay_use_id").isNotNull())
    # Σ cleared per paid bill and payment-bill status, before meeting the receivables
    paid = pays.groupBy("use_id", "use_bill_type", "pay_use_id").agg(
        F.sum("cleared_amount").alias("cleared"))
    paid = paid.withColumnRenamed("use_id", "bill_id").withColumnRenamed("use_bill_type", "bill_type")
    x = lookup_join(a, paid, ["bill_id", "bill_type"], "inner")
    x = lookup_join(x, _type_names(t, "bill_type", "d_name"), "bill_type", "inner")
    x = lookup_join(x, _party_names(t), "party_id", "inner")
    g = x.groupBy("d_name", "name", "bill_code", "bill_date", "bill_amount",
                  "original_bill_amount", "full_bill_date", "pay_use_id", "status").agg(
        F.coalesce(F.sum("cleared"), F.lit(0)).cast(SUM).alias("paid_amount"))
    return g.orderBy(F.col("status").desc(), F.col("full_bill_date").desc()).select(
        F.col("d_name").alias("bill_name"),
        X.canceled_flag(F.col("status") < 0).alias("is_bill_canceled"),
        F.col("name").alias("customer_name"), "bill_code", "bill_date",
        F.col("bill_amount").alias("receivable_amount"), "original_bill_amount", "paid_amount",
        (F.col("bill_amount") - F.col("paid_amount")).cast(SUM).alias("not_paid_amount"))


def receivable_detail(t: Tables, period: Period, shared: SharedPlans | None = None) -> DataFrame:
    """One row per receivable and payment line; unpaid receivables kept."""
    a = _receivables_in_period(t, period, detail=True)
    pays = settlements(_payments_of(t, a), live_only=False, receivable_types_only=True).select(
        F.col("use_id").alias("bill_id"), F.col("use_bill_type").alias("bill_type"),
        "cleared_amount", "pay_bill_type", "pay_bill_code", "pay_bill_date", "pay_use_id")
    x = left_join_split_hot_right(a, pays, ["bill_id", "bill_type"])
    x = lookup_join(x, _type_names(t, "bill_type", "d_name"), "bill_type", "inner")
    x = lookup_join(x, _type_names(t, "pay_bill_type", "e_name"), "pay_bill_type", "left", spread=("bill_id",))
    x = lookup_join(x, _party_names(t), "party_id", "inner")
    return x.orderBy(F.col("status").desc(), F.col("full_bill_date").desc(),
                     F.col("bill_code").desc()).select(
        F.col("d_name").alias("bill_name_1"),
        X.canceled_flag(F.col("status") < 0).alias("is_bill_canceled"),
        F.col("name").alias("customer_name"), F.col("bill_code").alias("bill_code_1"),
        F.col("bill_date").alias("bill_date_1"), F.col("bill_amount").alias("receivable_amount"),
        "original_bill_amount", F.col("e_name").alias("bill_name_2"),
        X.canceled_flag(F.col("pay_use_id") < 0).alias("is_pay_canceled"),
        F.col("pay_bill_code").alias("bill_code_2"), F.col("pay_bill_date").alias("bill_date_2"),
        F.col("cleared_amount").alias("paid_amount"))


# ------------------------------------------------------------ registry

REPORT_GROUPS: dict[str, tuple[tuple[str, Callable[..., DataFrame]], ...]] = {
    "Bill_Report": (
        ("Bill_Relation_Purchase", bill_relation_purchase),
        ("Bill_Relation_Sale", bill_relation_sale),
    ),
    "Sale_Report": (
        ("Product_Sale", product_sale),
        ("Product_Category_Sale", product_category_sale),
        ("Product_Never_Sold", product_never_sold),
    ),
    "Customer_Report": (
        ("Customer_Product", customer_product),
        ("Customer_Product_Category", customer_product_category),
        ("Customer_Summary", customer_summary),
        ("Customer_Detail", customer_detail),
        ("Customer_Info", customer_info),
    ),
    "Account_Receivable_Report": (
        ("Receivable_Summary", receivable_summary),
        ("Receivable_Detail", receivable_detail),
    ),
}
