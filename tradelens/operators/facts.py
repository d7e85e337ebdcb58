"""Sale facts (B1-B6), receivables (B15) and settlements.

``sale_facts`` is the one fact DataFrame every sales and customer report
reads: stock sale lines, live price adjustments and open plus archived retail
lines, unioned by name after casting each branch to the same 14-column
contract. With a period, every branch filters its bill headers first (the
predicate reaches the parquet scan). Line tables stored with their bill's
month (``write_monthly_tables``) are pruned to the period's months, so a
report over one period never reads, let alone shuffles, the whole line history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradelens.functions import expressions as X
from tradelens.functions.period import Period, in_period, in_period_by_day
from tradelens.operators.lookup import left_join_split_hot_right, lookup_join
from tradelens.operators.reduce import may_match
from tradelens.sources.contract import EFFECTIVE_PRICE, I, L, MONEY, MONTH, RATE, S, TS, Tables

SALE_FACT_COLUMNS = (
    ("bill_id", L), ("dept_id", L), ("party_id", L), ("handler_id", L), ("memo", S),
    ("goods_id", L), ("bill_date", TS), ("bill_code", S), ("bill_type", I),
    ("qty", MONEY), ("price", EFFECTIVE_PRICE), ("amount", MONEY),
    ("collect_amount", MONEY), ("disc_rate", RATE),
)


def _fact_contract(df: DataFrame) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.col(n) if have.get(n) == t and n in df.columns else F.col(n).cast(t).alias(n)
                       for n, t in SALE_FACT_COLUMNS])


def _bills_in(bills: DataFrame, period: Period | None) -> DataFrame:
    bills = lines_in(bills, period)
    return bills if period is None else bills.filter(in_period("bill_date", period))


def lines_in(lines: DataFrame, period: Period | None) -> DataFrame:
    """Lines (or bills) of the months that the period touches, where the stored table knows the month.

    Lines outside them belong to bills outside the period, and lines without
    a bill (NULL month) meet no bill, so the join with the period's bills gives
    the same rows.
    """
    if MONTH not in lines.columns:
        return lines
    if period is not None:
        first, last = period.start_ts, period.end_inclusive_ts
        lines = lines.filter(F.col(MONTH).between(first.year * 100 + first.month, last.year * 100 + last.month))
    return lines.drop(MONTH)


def lines_of(lines: DataFrame, bills: DataFrame, period: Period | None) -> DataFrame:
    """The lines that may belong to one of ``bills``, which are one period's (all lines without a period).

    Lines stored by month are pruned at the scan; others pass a bitmap of the bills'
    ids, so what is shuffled follows the period and not the history.
    """
    if period is None or MONTH in lines.columns:
        return lines_in(lines, period)
    return may_match(lines, ["bill_id"], bills, ["bill_id"])


def header_with_lines(bills: DataFrame, lines: DataFrame, period: Period | None = None) -> DataFrame:
    """``bills ⟕ lines`` on bill_id (line-less bills kept); one bill may hold a
    large share of all lines."""
    return left_join_split_hot_right(bills, lines_of(lines, bills, period), ["bill_id"])


def stock_sale_lines(t: Tables, period: Period | None = None) -> DataFrame:
    """B1: live sale invoices and returns with their lines (line-less bills kept).

    The return sign applies to the amount only; the price is discounted.
    """
    bills = _bills_in(t.stock_bill.filter(
        (F.col("use_id") >= 0) & F.col("bill_type").isin(X.SALE_INVOICE, X.SALE_RETURN)), period)
    lines = lines_of(t.stock_line, bills, period).select(
        "bill_id", "goods_id", F.col("qty"), F.col("price").alias("line_price"),
        F.col("amount").alias("line_amount"), "disc_rate")
    joined = header_with_lines(bills, lines)
    return _fact_contract(joined.select(
        "bill_id", "dept_id", "party_id", "handler_id", "memo", "goods_id", "bill_date",
        "bill_code", "bill_type", "qty",
        (F.col("line_price") * F.col("disc_rate")).alias("price"),
        X.return_signed("line_amount", "bill_type").alias("amount"),
        F.lit(0).alias("collect_amount"), "disc_rate"))


def adjustment_lines(t: Tables, period: Period | None = None) -> DataFrame:
    """B2: live price-adjustment bills as one goods-less line each."""
    adj = _bills_in(t.adj_bill.filter(
        (F.col("use_id") >= 0) & (F.col("bill_type") == X.PRICE_ADJUSTMENT)), period)
    return _fact_contract(adj.select(
        "bill_id", "dept_id", "party_id", "handler_id", "memo",
        F.lit(0).alias("goods_id"), "bill_date", "bill_code", "bill_type",
        F.lit(0).alias("qty"), F.lit(0).alias("price"), F.col("bill_amount").alias("amount"),
        F.lit(0).alias("collect_amount"), F.lit(1).alias("disc_rate")))


def _pos_branch(bill_table: DataFrame, line_table: DataFrame, period: Period | None) -> DataFrame:
    bills = _bills_in(bill_table, period).select("bill_id", "stock_id", "party_id", "handler_id", "bill_date",
                                                 "sequence_id", "memo")
    joined = header_with_lines(bills, line_table, period)
    return joined.select(
        "bill_id", F.lit(X.RETAIL_BILL).cast("int").alias("bill_type"), "stock_id", "party_id",
        "handler_id", "bill_date", F.col("sequence_id").cast("string").alias("bill_code"),
        "memo", "goods_id", "qty", "price", "amount", "disc_rate")


def pos_open_lines(t: Tables, period: Period | None = None) -> DataFrame:
    """Retail bills not yet archived (no cancel filter; price not discounted)."""
    return _pos_branch(t.pos_bill, t.pos_line, period)


def pos_hist_lines(t: Tables, period: Period | None = None) -> DataFrame:
    """Archived retail bills."""
    return _pos_branch(t.pos_bill_hist, t.pos_line_hist, period)


def pos_lines(t: Tables, period: Period | None = None, with_dept: bool = True) -> DataFrame:
    """B3 ∪ B4 with the department of the selling site (null if unknown, or not asked for)."""
    pos = pos_open_lines(t, period).unionByName(pos_hist_lines(t, period))
    if with_dept:
        pos = lookup_join(pos, t.stock_site, "stock_id", "left", spread=("bill_id",))
    else:
        pos = pos.withColumn("dept_id", F.lit(None).cast(L))
    return _fact_contract(pos.withColumn("collect_amount", F.lit(0)))


def sale_facts(t: Tables, period: Period | None = None, with_dept: bool = True) -> DataFrame:
    """The unified 14-column sale fact DataFrame (of one period if given).

    No report shows the department: they pass ``with_dept=False`` and save the
    site join of the retail lines.
    """
    return (stock_sale_lines(t, period).unionByName(adjustment_lines(t, period))
            .unionByName(pos_lines(t, period, with_dept)))


# ---------------------------------------------------------------- receivables

RECEIVABLE_COLUMNS = ("bill_id", "bill_date", "full_bill_date", "party_id", "bill_type",
                      "bill_amount", "original_bill_amount", "bill_code", "status")


def receivables(t: Tables, detail: bool = False, period: Period | None = None) -> DataFrame:
    """Amounts owed by customers.

    Retail credit parts of archived retail bills (never cancelled) plus stock
    bills of types 1201/1207 (cancelled kept). ``bill_date`` is the day,
    ``full_bill_date`` the timestamp. ``status`` is the cancel status
    (0 / −1) for the summary flavour and the raw ``use_id`` for the detail
    flavour (0 for retail credit). With a period, only receivables whose
    *day* lies in it (F2) are kept, filtered on the headers before any join.
    """
    hist = t.pos_bill_hist
    stock_bills = t.stock_bill.filter(F.col("bill_type").isin(X.SALE_INVOICE, X.RETAIL_BILL))
    credit = t.pos_collect_hist.filter(F.col("collect_amount") > 0)
    if period is not None:
        hist = hist.filter(in_period_by_day("bill_date", period))
        stock_bills = stock_bills.filter(in_period_by_day("bill_date", period))
    pos = lookup_join(credit, hist, "bill_id", "inner").select(
        "bill_id", X.day_of("bill_date").alias("bill_date"), F.col("bill_date").alias("full_bill_date"),
        "party_id", F.lit(X.RETAIL_BILL).alias("bill_type"),
        F.col("collect_amount").alias("bill_amount"),
        F.col("bill_amount").alias("original_bill_amount"),
        F.col("custom_code").alias("bill_code"), F.lit(0).alias("status"))
    stock = stock_bills.select(
        "bill_id", X.day_of("bill_date").alias("bill_date"), F.col("bill_date").alias("full_bill_date"),
        "party_id", "bill_type", "bill_amount",
        F.col("bill_amount").alias("original_bill_amount"), "bill_code",
        (F.col("use_id") if detail else X.live_status("use_id")).alias("status"))
    types = dict(bill_id=L, bill_date=TS, full_bill_date=TS, party_id=L, bill_type=I,
                 bill_amount=MONEY, original_bill_amount=MONEY, bill_code=S, status=L)

    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(types[c]).alias(c) for c in RECEIVABLE_COLUMNS])

    return cast(pos).unionByName(cast(stock))


def settlements(t: Tables, live_only: bool, receivable_types_only: bool = False) -> DataFrame:
    """Payment lines with their payment bill (live bills only if asked).

    ``live_only`` keeps the summary's semantics: a line whose bill is
    cancelled keeps no bill columns (the filter sits in the join condition).
    ``receivable_types_only`` keeps payments of the types that are receivables.
    """
    lines = t.pay_line
    if receivable_types_only:
        lines = lines.filter(F.col("use_bill_type").isin(X.SALE_INVOICE, X.RETAIL_BILL))
    bills = t.pay_bill.select(
        "pay_bill_id", F.col("bill_type").alias("pay_bill_type"),
        F.col("bill_code").alias("pay_bill_code"), F.col("bill_date").alias("pay_bill_date"),
        F.col("use_id").alias("pay_use_id"))
    if live_only:
        bills = bills.filter(F.col("pay_use_id") >= 0)
    return lookup_join(lines, bills, "pay_bill_id", "left")
