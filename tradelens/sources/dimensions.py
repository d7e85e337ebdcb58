"""The static document-type → English name dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.sources.contract import SCHEMAS

# English names of the document types (type id, name), as
# shipped by the source system.
BILL_TYPE_ENGLISH_NAMES = (
    (1101, "PurchaseInvoice"),
    (1102, "WarehouseEntry"),
    (1199, "SaleReturn"),
    (1201, "SaleInvoice"),
    (1202, "LeavingWarehouse"),
    (1299, "PurchaseReturn"),
    (1301, "PurchaseOrder"),
    (1302, "SaleOrder"),
)


def bill_type_en(spark: SparkSession) -> DataFrame:
    """Eight literal rows; safe to broadcast (fixed size)."""
    return spark.createDataFrame(list(BILL_TYPE_ENGLISH_NAMES), SCHEMAS["bill_type_en"])
