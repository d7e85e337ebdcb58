"""Scalar column expressions shared by the reports (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tradelens.sources.contract import MONEY

# Fixed values of the source system (document type codes and labels).
SALE_INVOICE = 1201
SALE_RETURN = 1199
RETAIL_BILL = 1207
PRICE_ADJUSTMENT = 1402
PURCHASE_INVOICE = 1101
WAREHOUSE_ENTRY = 1102
STOCK_IN = 1104
STOCK_OUT = 1204
STOCK_MOVEMENT_TYPES = (WAREHOUSE_ENTRY, STOCK_IN, STOCK_OUT)
STOCK_INBOUND_TYPES = (WAREHOUSE_ENTRY, STOCK_IN)
CUSTOMER_FUNCTION = 30700
CASH_CUSTOMER = "General(Cash)"
CANCELED = "Canceled"
QTY_LABEL = "Qty:"
AMT_LABEL = "Amt:"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col: Column | str) -> Column:
    return _c(col).cast(MONEY)


def return_signed(amount: Column | str, bill_type: Column | str) -> Column:
    """Returns (1199) negate the amount; quantities are not negated."""
    sign = F.when(_c(bill_type) == SALE_RETURN, F.lit(-1)).otherwise(F.lit(1))
    return (sign * _c(amount)).cast(MONEY)


def stock_signed(qty: Column | str, bill_type: Column | str) -> Column:
    """Inbound documents (1102, 1104) count +, everything else −."""
    sign = F.when(_c(bill_type).isin(*STOCK_INBOUND_TYPES), F.lit(1)).otherwise(F.lit(-1))
    return sign * _c(qty)


def ratio_or_zero(num: Column | str, den: Column | str) -> Column:
    """``num / den``, 0 when ``den`` is 0 (null stays null), as DOUBLE."""
    d = _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(_c(num).cast("double") / d.cast("double"))


def ratio_or_null(num: Column | str, den: Column | str) -> Column:
    """``num / den``, NULL when ``den`` is 0 or NULL, as DOUBLE."""
    d = _c(den)
    return _c(num).cast("double") / F.nullif(d, F.lit(0)).cast("double")


def customer_name(name: Column | str) -> Column:
    """Unknown and missing customers are shown as cash sales."""
    return F.coalesce(_c(name), F.lit(CASH_CUSTOMER))


def canceled_flag(is_canceled: Column) -> Column:
    """``'Canceled'`` when the condition holds, else ``''`` (null → ``''``)."""
    return F.when(is_canceled, F.lit(CANCELED)).otherwise(F.lit(""))


def live_status(use_id: Column | str) -> Column:
    """0 for a live document (use_id >= 0), −1 otherwise (null → −1)."""
    return F.when(_c(use_id) >= 0, F.lit(0)).otherwise(F.lit(-1))


def day_of(ts: Column | str) -> Column:
    """Midnight of the same day, staying TIMESTAMP_NTZ."""
    return _c(ts).cast(T.DateType()).cast(T.TimestampNTZType())
