"""tradelens — Spark-native analytics over trade documents.

Sale invoices, returns, price adjustments and open and archived retail
receipts are unified into one fact DataFrame; sales, margin, stock movement,
customer, document-chain and receivable reports are plain DataFrame plans
over it (joins, unions, null-aware anti joins, two-level aggregations).

Layout:

* ``sources``   contract schemas, parquet / JDBC loaders, static dimensions,
                and the test-data derivation used by the oracle checks
* ``functions`` column expressions: period predicates, sign rules, guarded
                ratios, day truncation, column width profile
* ``operators`` reusable sub-plans: lookup joins with salted hot keys, the
                null-aware anti join, sale facts, stock totals, bill chains,
                receivables and settlements
* ``plans``     the twelve reports and the report bundle (grouping, staging,
                distributed writes)
"""

from tradelens.functions.period import Period

__all__ = ["Period"]
