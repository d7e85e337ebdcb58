"""Typed contract of the ERP tables the reports read.

Every loader (parquet, JDBC, test-data derivation) hands back DataFrames cast
to exactly these schemas, so report plans never see source-specific types.
Amounts and quantities are DECIMAL(18,2), cost prices DECIMAL(18,4), discount
rates DECIMAL(9,4); dates are TIMESTAMP_NTZ (wall-clock, no zone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

L = T.LongType()
I = T.IntegerType()
S = T.StringType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)
COST = T.DecimalType(18, 4)
RATE = T.DecimalType(9, 4)
# effective price = price * discount rate, kept exact
EFFECTIVE_PRICE = T.DecimalType(22, 6)


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    # no DDL exists for the source tables, so nothing is declared NOT NULL
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


_LINE = (("bill_id", L), ("goods_id", L), ("qty", MONEY), ("price", MONEY),
         ("amount", MONEY), ("disc_rate", RATE))
_POS_BILL = (("bill_id", L), ("stock_id", L), ("party_id", L), ("handler_id", L),
             ("bill_date", TS), ("sequence_id", L), ("memo", S))

SCHEMAS: dict[str, T.StructType] = {
    "stock_bill": _schema(
        ("bill_id", L), ("dept_id", L), ("party_id", L), ("handler_id", L), ("memo", S),
        ("bill_date", TS), ("bill_code", S), ("bill_type", I), ("use_id", L),
        ("bill_amount", MONEY)),
    "stock_line": _schema(*_LINE),
    "stock_bill_browse": _schema(
        ("bill_id", L), ("bill_type", I), ("bill_code", S), ("bill_date", TS),
        ("bill_amount", MONEY), ("qty", MONEY), ("use_id", L), ("use_bill_type", I),
        ("relation_from", S)),
    "adj_bill": _schema(
        ("bill_id", L), ("dept_id", L), ("party_id", L), ("handler_id", L), ("memo", S),
        ("bill_date", TS), ("bill_code", S), ("bill_type", I), ("bill_amount", MONEY),
        ("use_id", L)),
    "pos_bill": _schema(*_POS_BILL),
    "pos_line": _schema(*_LINE),
    "pos_bill_hist": _schema(*_POS_BILL, ("bill_amount", MONEY), ("custom_code", S)),
    "pos_line_hist": _schema(*_LINE),
    "pos_collect_hist": _schema(("bill_id", L), ("collect_amount", MONEY)),
    "stock_site": _schema(("stock_id", L), ("dept_id", L)),
    "goods": _schema(
        ("goods_id", L), ("goods_code", S), ("goods_name", S), ("model", S),
        ("class_id", I), ("sale_price", MONEY), ("ref_cost", COST)),
    "goods_class": _schema(("class_id", I), ("class_code", S), ("class_name", S)),
    "party": _schema(
        ("party_id", L), ("code", S), ("name", S), ("address", S), ("postcode", S),
        ("contact", S), ("tele", S), ("mobile", S), ("fax", S), ("email", S),
        ("website", S), ("country", S), ("company", S), ("city", S),
        ("create_date", TS), ("function_id", I), ("no_use", I)),
    "bill_type": _schema(("type_id", I), ("name", S)),
    "bill_type_en": _schema(("type_id", I), ("english_name", S)),
    "order_bill": _schema(("bill_id", L), ("bill_date", TS), ("bill_amount", MONEY)),
    "order_line": _schema(("bill_id", L), ("qty", MONEY)),
    "pay_line": _schema(("pay_bill_id", L), ("use_id", L), ("use_bill_type", I),
                        ("cleared_amount", MONEY)),
    "pay_bill": _schema(("pay_bill_id", L), ("bill_type", I), ("bill_code", S),
                        ("bill_date", TS), ("use_id", L)),
    "sold_goods": _schema(("goods_code", S)),
}

TABLE_NAMES = tuple(SCHEMAS)

# Columns that only are shown, never joined, filtered or summed: a source may lack them.
_SHOWN = ("dept_id", "handler_id", "memo")
OPTIONAL: dict[str, tuple[str, ...]] = {
    "stock_bill": _SHOWN, "adj_bill": _SHOWN,
    "pos_bill": ("handler_id", "memo"), "pos_bill_hist": ("handler_id", "memo"),
    "party": ("address", "postcode", "contact", "tele", "mobile", "fax", "email", "website",
              "country", "company", "city", "create_date"),
}

# Year and month (yyyymm) of a bill, in line and header tables that are stored by month.
MONTH = "bill_month"
# The browse view stored by its link, where a layout has it.
LINK_INDEX = "browse_by_link"
LINE_HEADERS = {"stock_line": "stock_bill", "pos_line": "pos_bill", "pos_line_hist": "pos_bill_hist"}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the contract of ``table``: select, cast, order.

    Missing ``OPTIONAL`` columns become typed NULLs, any other missing column
    raises ``ValueError``. Extra columns are dropped (so column pruning reaches
    the scan), but a line or header table keeps its ``MONTH``.
    """
    schema = SCHEMAS["stock_bill_browse" if table == LINK_INDEX else table]
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have and f.name not in OPTIONAL.get(table, ())]
    if missing:
        raise ValueError(f"table {table} lacks the columns {missing}")
    if list(have.items()) == [(f.name, f.dataType) for f in schema.fields]:
        return df
    cols = []
    for field in schema.fields:
        if have.get(field.name) == field.dataType:
            cols.append(F.col(field.name))
            continue
        src = F.col(field.name) if field.name in have else F.lit(None)
        cols.append(src.cast(field.dataType).alias(field.name))
    if (table in LINE_HEADERS or table in LINE_HEADERS.values()) and MONTH in have:
        cols.append(F.col(MONTH))
    return df.select(*cols)


class Tables(dict):
    """Name → DataFrame mapping with attribute access (``t.stock_bill``)."""

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:  # pragma: no cover - programming error
            raise AttributeError(name) from exc
