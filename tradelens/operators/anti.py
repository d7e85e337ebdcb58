"""``probe NOT IN (SELECT code FROM list)`` with SQL null semantics.

SQL ``NOT IN`` is null-aware: a NULL anywhere in the list makes every probe
unknown (no row survives), and a NULL probe survives only when the list is
empty. A plain ``left_anti`` join gets both cases wrong.

Catalyst's own null-aware anti join needs the whole list side broadcast (or
falls back to a nested-loop join), so the list is reduced instead:

* the list values are de-duplicated once (partial + final aggregation; a
  NULL value survives as one NULL row);
* the non-null distinct values feed an ordinary hash / sort-merge
  ``left_anti`` join — any size;
* one scalar subquery over the distinct values gives (distinct count,
  distinct non-null count), which decide the empty-list and has-a-null
  cases without pairing any rows; Spark runs it once and reuses the result
  in every predicate that names it (the list is read twice in all: once for
  the join side, once for the counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def not_in(probe: DataFrame, probe_col: str, values: DataFrame, value_col: str) -> DataFrame:
    """Rows of ``probe`` whose ``probe_col`` is NOT IN ``values.value_col``."""
    distinct_vals = values.select(F.col(value_col).alias("__v")).distinct()
    stats = distinct_vals.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                       F.count("__v").alias("n_nonnull")).alias("s")).scalar()
    non_null = distinct_vals.filter(F.col("__v").isNotNull())
    candidates = probe.join(non_null, probe[probe_col] == non_null["__v"], "left_anti")
    list_is_empty = stats["n"] == 0
    list_has_null = stats["n"] > stats["n_nonnull"]
    keep = list_is_empty | (~list_has_null & F.col(probe_col).isNotNull())
    return candidates.filter(keep)
