"""One stored layout for period reports and for joins over the whole history.

``write_copartitioned_tables`` stores the contract as catalog tables:

* headers and lines by the month of their bill **and** bucketed by ``bill_id``: a
  report prunes to its period's months, and its header ⋈ line join finds both
  sides bucketed alike, without an exchange;
* a link index: the browse view twice, bucketed by (bill_id, bill_type) and by the
  link (use_id, use_bill_type), so the chain's self join of any size needs
  no exchange; order bills and lines bucketed by ``bill_id``;
* payment lines and bills bucketed by ``pay_bill_id``.

``refresh_months`` rewrites the months of bills that came late, moved or
vanished, and no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradelens.sources.contract import LINE_HEADERS, LINK_INDEX, MONTH, TABLE_NAMES, Tables, conform
from tradelens.sources.dimensions import bill_type_en

# The columns each table is bucketed and sorted by.
BUCKETS: dict[str, tuple[str, ...]] = {
    "stock_bill": ("bill_id",), "stock_line": ("bill_id",),
    "pos_bill": ("bill_id",), "pos_line": ("bill_id",),
    "pos_bill_hist": ("bill_id",), "pos_line_hist": ("bill_id",), "pos_collect_hist": ("bill_id",),
    "order_bill": ("bill_id",), "order_line": ("bill_id",),
    "pay_line": ("pay_bill_id",), "pay_bill": ("pay_bill_id",),
    "stock_bill_browse": ("bill_id", "bill_type"), LINK_INDEX: ("use_id", "use_bill_type"),
}
MONTHLY = (*LINE_HEADERS, *LINE_HEADERS.values())


def bill_month(date: str = "bill_date") -> Column:
    """yyyymm of a bill; bills without a date, and lines without a bill, go to month 0."""
    return F.coalesce(F.year(date) * 100 + F.month(date), F.lit(0)).cast("int")


def with_month(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A header or line table with the month of its bill."""
    df = tables[name].drop(MONTH)
    if name not in LINE_HEADERS:
        return df.withColumn(MONTH, bill_month())
    months = tables[LINE_HEADERS[name]].select("bill_id", bill_month().alias(MONTH))
    return (df.join(months, "bill_id", "left").withColumn(MONTH, F.coalesce(MONTH, F.lit(0)))
            .select(*df.columns, MONTH))


def buckets_for(tables: Mapping[str, DataFrame], rows: int = 1_000_000, least: int = 8) -> int:
    """A bucket count for tables as they are: about ``rows`` rows of the largest table in a bucket.

    One task joins a bucket, so the count follows the rows. Tables stored by month are read
    a few months at a time; of them the largest month of a header table counts.
    """
    most = 0
    for name, df in tables.items():
        if name in LINE_HEADERS.values():
            months = df.groupBy(bill_month().alias(MONTH)).agg(F.count(F.lit(1)).alias("rows"))
            most = max(most, months.agg(F.max("rows")).first()[0] or 0)
        elif name in BUCKETS and name not in MONTHLY:
            most = max(most, df.select(BUCKETS[name][0]).count())
    return max(least, -(-most // rows))


def _dealt(df: DataFrame, keys: Iterable[str], buckets: int) -> DataFrame:
    """Rows of one bucket (and month) together, in tasks of about equal size: a large
    bucket is written by several tasks, so a task doesn't grow with the table."""
    cell = ["__bucket", *([MONTH] if MONTH in df.columns else [])]
    return (df.withColumn("__bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
            .hint("rebalance", *cell).drop("__bucket"))


def write_copartitioned_tables(spark: SparkSession, tables: Mapping[str, DataFrame], root: str,
                               database: str = "tradelens", buckets: int = 64) -> None:
    """Write contract tables, and the link index, as catalog tables under ``root``.

    A month has a file per bucket, or several where a bucket is large. Pick
    ``buckets`` so that a bucket of the largest table's month is at
    least some MB and a bucket of the whole table fits a task (``buckets_for``).
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = list(tables)
    if "stock_bill_browse" in tables:
        names = [*(n for n in names if n != LINK_INDEX), LINK_INDEX]
    for name in names:
        # the index has the rows of the view, which is computed once and read back
        df = spark.table(f"{database}.stock_bill_browse") if name == LINK_INDEX else tables[name]
        keys = BUCKETS.get(name, ())
        if name in MONTHLY:
            df = with_month(tables, name)
        if keys:
            df = _dealt(df, keys, buckets)
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{root.rstrip('/')}/{name}")
        if name in MONTHLY:
            writer = writer.partitionBy(MONTH)
        if keys:
            writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
        writer.saveAsTable(f"{database}.{name}")


def load_copartitioned_tables(spark: SparkSession, database: str = "tradelens",
                              names: Iterable[str] = (*TABLE_NAMES, LINK_INDEX)) -> Tables:
    """The tables of ``write_copartitioned_tables``, with their buckets and months."""
    out = Tables()
    for name in names:
        if spark.catalog.tableExists(f"{database}.{name}"):
            out[name] = conform(spark.table(f"{database}.{name}"), name)
        elif name == "bill_type_en":
            out[name] = bill_type_en(spark)
        else:
            raise ValueError(f"missing table {database}.{name}")
    return out


def changed_months(stored: Mapping[str, DataFrame], tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """(bill_month): the months of a header or line table whose rows differ from the stored ones.

    Compares row counts and two order-free checksums per month, so a bill that
    moved names both of its months, and a deleted row its own.
    """
    def state(df: DataFrame) -> DataFrame:
        columns = [F.col(c) for c in sorted(set(df.columns) - {MONTH})]
        return df.groupBy(MONTH).agg(
            F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("x"),
            F.sum(F.hash(*columns).cast("long")).alias("y"))  # 32 bits: the sum can't overflow

    fields = ("rows", "x", "y")
    new = state(with_month(tables, name)).select(MONTH, F.struct(*fields).alias("new"))
    old = state(stored[name]).select(MONTH, F.struct(*fields).alias("old"))
    return new.join(old, MONTH, "full").filter(~F.col("new").eqNullSafe(F.col("old"))).select(MONTH)


def refresh_months(spark: SparkSession, tables: Mapping[str, DataFrame], database: str = "tradelens") -> dict[str, list[int]]:
    """Bring the monthly tables up to date: only months whose rows changed are written again.

    Returns the months per table. A month that lost all its rows is emptied. The other tables of the layout aren't monthly and are written as a whole
    by ``write_copartitioned_tables``.
    """
    stored = load_copartitioned_tables(spark, database, MONTHLY)
    months = {name: sorted(r[MONTH] for r in changed_months(stored, tables, name).collect())  # one row a month
              for name in MONTHLY}
    for name, changed in months.items():
        if not changed:
            continue
        table = f"{database}.{name}"
        layout = spark.table(table)
        rows = with_month(tables, name).filter(F.col(MONTH).isin(changed)).select(*layout.columns)
        view, columns = f"fresh_{name}", ", ".join(c for c in layout.columns if c != MONTH)
        _dealt(rows, BUCKETS[name], _bucket_count(spark, table)).createOrReplaceTempView(view)
        for month in changed:  # also with no rows, which empties the month
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({MONTH} = {month}) "
                      f"SELECT {columns} FROM {view} WHERE {MONTH} = {month}")
        spark.catalog.dropTempView(view)
    return months


def _bucket_count(spark: SparkSession, table: str) -> int:
    """Buckets of a stored table."""
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").collect()
    return int(next(r.data_type for r in rows if r.col_name == "Num Buckets"))
