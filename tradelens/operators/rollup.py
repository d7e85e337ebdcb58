"""Maintained stock totals: partial sums per goods, document type and month.

The all-time net stock needs every movement line ever. The rollup stores its
partial sums once, in one folder per month; a report adds them up with the fresh lines of
the months that are still open. Sums distribute over the split into months, so
the totals equal the full recomputation.

    write_stock_rollup(t, root)                       # once
    refresh_stock_rollup(t, root, months)             # after late or changed lines
    t["stock_rollup"] = load_stock_rollup(t, root, open_months=[202412])
    reports.product_sale(t, period)                   # reads the rollup
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tradelens.functions import expressions as X
from tradelens.operators.lookup import lookup_join
from tradelens.operators.reduce import may_match
from tradelens.sources.contract import MONTH, Tables
from tradelens.sources.copartitioned import bill_month

ROLLUP = "stock_rollup"
#: The type of the row that every written month has, so that a month without movements is overwritten too.
NO_MOVEMENT = 0
_COLUMNS = ("goods_id", "bill_type", "qty", "lines", MONTH)


def stock_partials(t: Tables, months: Iterable[int] | None = None) -> DataFrame:
    """(goods_id, bill_type, qty, lines, bill_month): sums over the movement lines of the months (all if None).

    Cancelled bills count, as in the totals. Line tables stored by month are pruned,
    others reduced to lines that may belong to the months' bills before they are shuffled.
    """
    bills = t.stock_bill.filter(F.col("bill_type").isin(*X.STOCK_MOVEMENT_TYPES)).select(
        "bill_id", "bill_type", bill_month().alias("month"))
    lines = t.stock_line
    if months is not None:
        wanted = list(months)
        bills = bills.filter(F.col("month").isin(wanted))
        if MONTH in lines.columns:  # NULL: stored without a bill or date
            lines = lines.filter(F.coalesce(F.col(MONTH), F.lit(0)).isin(wanted))
        else:
            lines = may_match(lines, ["bill_id"], bills, ["bill_id"])
    joined = lookup_join(lines.select("bill_id", "goods_id", "qty"), bills, "bill_id", "inner")
    return joined.groupBy("goods_id", "bill_type", "month").agg(
        F.sum("qty").cast("decimal(38,2)").alias("qty"), F.count(F.lit(1)).alias("lines")).select(
        "goods_id", "bill_type", "qty", "lines", F.col("month").alias(MONTH))


def write_stock_rollup(t: Tables, root: str) -> None:
    """Write the partial sums of all months under ``root``.

    They are written as the aggregation dealt them: no second shuffle, and no month is one task's.
    """
    stock_partials(t).write.mode("overwrite").partitionBy(MONTH).parquet(root)


def refresh_stock_rollup(t: Tables, root: str, months: Iterable[int]) -> None:
    """Compute some months anew and overwrite those, also if they have no movements any more."""
    wanted = sorted(set(months))
    if not wanted:
        return
    spark = t.stock_bill.sparkSession
    nothing = spark.range(1).select(
        F.lit(None).cast("long").alias("goods_id"), F.lit(NO_MOVEMENT).alias("bill_type"),
        F.lit(None).cast("decimal(38,2)").alias("qty"), F.lit(0).cast("long").alias("lines"),
        F.explode(F.array(*[F.lit(m) for m in wanted])).alias(MONTH))
    (stock_partials(t, wanted).unionByName(nothing).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(root))


def read_stock_rollup(t: Tables, root: str) -> DataFrame:
    """The stored partial sums."""
    types = "goods_id long, bill_type int, qty decimal(38,2), lines long, bill_month int"
    return (t.stock_bill.sparkSession.read.schema(types).parquet(root)
            .filter(F.col("bill_type") != NO_MOVEMENT).select(*_COLUMNS))


def load_stock_rollup(t: Tables, root: str, open_months: Iterable[int] = ()) -> DataFrame:
    """Stored sums of the closed months and fresh ones of ``open_months``."""
    stored, fresh = read_stock_rollup(t, root), sorted(set(open_months))
    if not fresh:
        return stored
    return stored.filter(~F.col(MONTH).isin(fresh)).unionByName(stock_partials(t, fresh))


def stale_months(t: Tables, root: str) -> DataFrame:
    """(bill_month): months whose stored sums differ from the lines as they are now.

    Recomputes all partial sums (one pass over the history), so it is a check to
    run now and then, not before each report.
    """
    keys = ["goods_id", "bill_type", MONTH]
    now = stock_partials(t).select(*keys, F.struct("qty", "lines").alias("now"))
    then = read_stock_rollup(t, root).select(*keys, F.struct("qty", "lines").alias("then"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = now.alias("a").join(then.alias("b"), same, "full")
    return (both.filter(~F.col("now").eqNullSafe(F.col("then")))
            .select(F.coalesce(F.col(f"a.{MONTH}"), F.col(f"b.{MONTH}")).alias(MONTH)).distinct())


def totals_from_rollup(rollup: DataFrame) -> DataFrame:
    """B7 from partial sums: net stock quantity per goods, all time."""
    return rollup.groupBy("goods_id").agg(
        F.sum(X.stock_signed("qty", "bill_type")).cast("decimal(38,2)").alias("total_import"))
