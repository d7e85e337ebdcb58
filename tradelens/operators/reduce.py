"""Reduction before a shuffle: rows that can't meet the other side stay where they are.

``may_match`` keeps the rows of a large table whose key may be among another
table's keys. The keys are hashed into a bitmap of fixed size, built by one
aggregation and read as a scalar subquery of the plan (nothing runs while the plan is
built), so a table's history isn't shuffled for a join with one period's bills. The
bitmap never loses a match; what it lets through by chance, or when it is
full, is left to the join behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the bitmap: 1 MB, whatever the number of keys.
BITS = 1 << 23


def _slot(columns: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def key_bitmap(keys: DataFrame) -> DataFrame:
    """One row with one array of longs: a bit for each hash of the rows of ``keys``."""
    slots = keys.dropna().select(_slot([F.col(c) for c in keys.columns]).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(BITS >> 6, numPartitions=1)  # a dense array needs all its words
    filled = every.join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("words")).select(
        F.col("words.bits").alias("words"))


def may_match(fact: DataFrame, keys: Sequence[str], other: DataFrame, other_keys: Sequence[str]) -> DataFrame:
    """The rows of ``fact`` whose ``keys`` may equal ``other_keys`` of a row of ``other``.

    Keys of a pair must have one type. A row with a NULL key matches nothing
    and is dropped, so use this on a side that the join doesn't preserve.
    """
    words = key_bitmap(other.select(*other_keys)).scalar()
    slot = _slot([F.col(k) for k in keys])
    word = F.get(words, F.shiftright(slot, 6).cast("int"))
    hit = F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1
    for k in keys:
        hit = F.col(k).isNotNull() & hit
    return fact.filter(hit)
