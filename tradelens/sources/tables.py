"""Load the contract tables from parquet or from a live database (JDBC).

Both loaders return :class:`Tables` whose DataFrames are cast to the
contract (``contract.SCHEMAS``). Nothing is read eagerly: the casts sit on
top of the scan, so Catalyst still prunes columns and pushes the report
predicates (period bounds, type lists, live flags) into the parquet reader.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelens.sources.contract import LINE_HEADERS, MONTH, TABLE_NAMES, Tables, conform
from tradelens.sources.dimensions import bill_type_en


def load_parquet_tables(spark: SparkSession, root: str,
                        names: Iterable[str] = TABLE_NAMES) -> Tables:
    """One ``spark.read.parquet(root/<name>)`` per contract table.

    ``bill_type_en`` falls back to the built-in static dimension when the
    folder has no such table; any other error, and any other missing table,
    is raised.
    """
    out = Tables()
    for name in names:
        path = f"{root.rstrip('/')}/{name}"
        try:
            out[name] = conform(spark.read.parquet(path), name)
        except AnalysisException as error:
            if name != "bill_type_en" or error.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = bill_type_en(spark)
    return out


# Tables that grow with the business: never read over one connection by accident.
GROWING = ("stock_bill", "stock_line", "stock_bill_browse", "adj_bill", "pos_bill", "pos_line", "pos_bill_hist",
           "pos_line_hist", "pos_collect_hist", "order_bill", "order_line", "pay_line", "pay_bill")


def load_jdbc_tables(spark: SparkSession, url: str, source_names: Mapping[str, str],
                     properties: Mapping[str, str] | None = None,
                     partitioning: Mapping[str, tuple[str, int, int, int]] | None = None,
                     single_connection: Iterable[str] = ()) -> Tables:
    """Read the contract tables from a database over JDBC.

    ``source_names`` maps contract names to database tables or views (a view
    may rename the source columns to the contract names). ``partitioning``
    gives, per large table, ``(column, lower, upper, num_partitions)`` so the
    read is split into parallel range scans instead of one connection. A
    ``GROWING`` table without it raises ``ValueError`` unless it is named in
    ``single_connection``.
    """
    props = dict(properties or {})
    parts = dict(partitioning or {})
    unsplit = [n for n in source_names if n in GROWING and n not in parts and n not in set(single_connection)]
    if unsplit:
        raise ValueError(f"give partitioning for {unsplit}, or name them in single_connection")
    out = Tables()
    for name, source in source_names.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", source)
        for key, value in props.items():
            reader = reader.option(key, value)
        if name in parts:
            column, lower, upper, n = parts[name]
            reader = (reader.option("partitionColumn", column)
                      .option("lowerBound", str(lower)).option("upperBound", str(upper))
                      .option("numPartitions", str(n)))
        out[name] = conform(reader.load(), name)
    if "bill_type_en" not in out:
        out["bill_type_en"] = bill_type_en(spark)
    return out


def write_parquet_tables(tables: Mapping[str, DataFrame], root: str,
                         mode: str = "overwrite") -> None:
    """Persist contract tables (e.g. a JDBC extract) as parquet folders."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def write_monthly_tables(tables: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Contract tables as parquet, the line tables partitioned by the month of their bill.

    The month comes from one header join at load. A period's reports then read
    only the partitions of its months (``lines_in``). Lines without a bill
    go to the NULL partition; no report shows them. A line whose bill's date
    changes must be written again.
    """
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        if name not in LINE_HEADERS:
            df.write.mode(mode).parquet(path)
            continue
        month = F.year("bill_date") * 100 + F.month("bill_date")
        headers = tables[LINE_HEADERS[name]].select("bill_id", month.alias(MONTH))
        lines = df.drop(MONTH).join(headers, "bill_id", "left").repartitionByRange(MONTH, "bill_id")
        lines.write.mode(mode).partitionBy(MONTH).parquet(path)


# Tables written bucketed by the key they are joined on, so header ⋈ line
# joins (and payment line ⋈ payment bill) find both sides already
# co-partitioned and sorted: no shuffle of either side, whatever their size.
BUCKET_KEYS = {
    "stock_bill": "bill_id", "stock_line": "bill_id",
    "pos_bill": "bill_id", "pos_line": "bill_id",
    "pos_bill_hist": "bill_id", "pos_line_hist": "bill_id", "pos_collect_hist": "bill_id",
    "pay_line": "pay_bill_id", "pay_bill": "pay_bill_id",
}


def write_bucketed_tables(spark: SparkSession, tables: Mapping[str, DataFrame], root: str,
                          database: str = "tradelens", buckets: int = 64) -> None:
    """Write contract tables as catalog tables under ``root``; header and line
    tables bucketed (and sorted) by their join key with one bucket count, so
    joins between them are co-located. Pick ``buckets`` so one bucket of the
    largest line table is a few hundred MB."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{root.rstrip('/')}/{name}")
        key = BUCKET_KEYS.get(name)
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def load_catalog_tables(spark: SparkSession, database: str = "tradelens",
                        names: Iterable[str] = TABLE_NAMES) -> Tables:
    """The contract tables from catalog tables (keeps their bucketing)."""
    out = Tables()
    for name in names:
        if spark.catalog.tableExists(f"{database}.{name}"):
            out[name] = conform(spark.table(f"{database}.{name}"), name)
        elif name == "bill_type_en":
            out[name] = bill_type_en(spark)
        else:
            raise ValueError(f"missing table {database}.{name}")
    return out
