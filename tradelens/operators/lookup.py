"""Joins for growing tables.

One plan per join at every size: nothing here counts rows, runs a job while a
plan is built, or picks another plan for large inputs. Joins are plain
equality joins; Spark's statistics and AQE decide whether a side is broadcast
and split skewed partitions. Only fixed literal lists carry a broadcast hint.
Two rewrites keep a hot key from landing in one task where AQE can't help:

* salted keys (:func:`lookup_join` with ``spread``): rows whose key is NULL
  (cash sales carry no customer) or one of the known hot values (a document
  that was made from nothing has link 0, a cancelled one -1) are spread over
  ``SPREAD`` partitions by a hash of columns the plan has anyway. The other
  side's rows with a hot value are repeated for every salt;
* :func:`left_join_split_hot_right` for a left join whose right side may hold
  one huge group (AQE splits only the preserved side of an outer join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SPREAD = 64


def lookup_join(fact: DataFrame, dim: DataFrame, keys: str | Sequence[str], how: str = "left",
                spread: Sequence[str] = (), hot: Sequence[int] = (), broadcast: bool = False) -> DataFrame:
    """Join ``fact`` to ``dim`` on equally named ``keys``.

    ``spread`` names columns of ``fact`` whose hash spreads rows with a NULL key
    or with a first key among ``hot``. ``broadcast`` is for dimensions built
    from a fixed literal list only.
    """
    key_list = [keys] if isinstance(keys, str) else list(keys)
    if broadcast:
        return fact.join(F.broadcast(dim), key_list, how)
    if not spread or how != "left":
        return fact.join(dim, key_list, how)
    spreads = F.lit(False)
    for k in key_list:
        spreads = spreads | F.col(k).isNull()
    if hot:
        spreads = spreads | F.col(key_list[0]).isin(*hot)
    salt = F.pmod(F.xxhash64(*spread), F.lit(SPREAD)) + 1
    salted = fact.withColumn("__salt", F.when(spreads, salt).otherwise(F.lit(0)))
    if hot:
        every = F.when(F.col(key_list[0]).isin(*hot), F.sequence(F.lit(1), F.lit(SPREAD))).otherwise(F.array(F.lit(0)))
        dim = dim.withColumn("__salt", F.explode(every.cast("array<bigint>")))
    else:
        dim = dim.withColumn("__salt", F.lit(0).cast("long"))
    return salted.join(dim, [*key_list, "__salt"], "left").drop("__salt")


def left_join_split_hot_right(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left ⟕ right`` on ``keys`` when one right-side key may hold a large
    share of all rows (one bill with a third of all lines).

    AQE can split a skewed partition only on the preserved side of an outer
    join, so a hot key on the right of a left join would land in one task.
    Written instead as ``left ⋈ right`` (inner: both sides splittable) plus
    the unmatched left rows, found by an anti join against the right side's
    distinct keys (partial aggregation shrinks the hot key to one row per
    map task before the shuffle). Column pruning narrows that second read of
    the right side to its key columns. Same rows as the outer join.
    """
    key_list = list(keys)
    matched = left.join(right, key_list, "inner")
    right_keys = right.select(*key_list).distinct()
    unmatched = left.join(right_keys, key_list, "left_anti")
    for field in right.schema.fields:
        if field.name not in key_list:
            unmatched = unmatched.withColumn(field.name, F.lit(None).cast(field.dataType))
    return matched.unionByName(unmatched.select(*matched.columns))
