"""Sharding: sampled splitters.

Records are thin here (id, text hash, size); the text is read once.

1. a size-weighted sample of the keys (the hash of the text, so equal texts
   are neighbours) is drawn over all rows; its quantiles are the splitters.
   A key that fills a whole quantile step is hot and gets a range of its own;
2. records are dealt into the ranges between splitters. A range that turns
   out overfull (exact sums) is subdivided by the hash of the key, so that equal
   texts stay neighbours; only keys beyond the group bound (a bounded number of
   them) are dealt by the hash of the id;
3. ranges have exact prefix sums of bytes and rows, a window inside each
   range places every record by the byte position of its middle. Equal
   texts stay together unless their group exceeds ``1/GROUP_PART`` of a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelens.llm.common import materialize

#: Ranges per shard at least, rows per range at most on average, sampled keys per range.
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 2_000_000
SAMPLES_PER_RANGE = 32
#: Groups of equal texts beyond this part of a shard's fair share may be cut.
GROUP_PART = 64


def thin_records(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, text_crc32): all that placing needs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are <= key, by binary search in a literal array."""
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    if not splitters:
        return F.lit(0)
    array = F.lit(splitters).cast("array<bigint>")
    return F.aggregate(
        F.lit(steps).cast("array<int>"), F.lit(0),
        lambda lo, s: lo + F.when((lo + s <= len(splitters)) & (F.get(array, lo + s - 1) <= key), s).otherwise(0))


def _splitters(sample: list[int], ranges: int) -> list[int]:
    """Quantiles of the sorted sample; a key found at two steps is fenced in on both sides."""
    if not sample:
        return []
    at = [sample[min(len(sample) - 1, i * len(sample) // ranges)] for i in range(1, ranges)]
    hot = {a for a, b in zip(at, at[1:], strict=False) if a == b and a < 2**63 - 1}
    return sorted({*at, *(k + 1 for k in hot)})


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0).

    Needs ``doc_id`` and ``text``. ``size`` is the text's UTF-8 bytes (NULL:
    none) plus 8. All shards get nearly equal bytes. Repeated rows are placed
    as often as they occur; NULL and empty texts are ordinary small records;
    an empty table gives an empty result.
    """
    thin = materialize(thin_records(docs), "thin-records")
    n_rows, n_bytes = thin.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES_PER_SHARD * shards, -(-n_rows // ROWS_PER_RANGE))
    wanted = ranges * SAMPLES_PER_RANGE
    # a row is drawn with a chance in proportion to its size, decided by its own hash; heavy rows count repeatedly
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("size") * wanted / F.lit(float(max(n_bytes, 1))) + draw).cast("int")
    sample = [r.key for r in thin.filter(times > 0)
              .select(F.explode(F.array_repeat("key", times)).alias("key")).orderBy("key").collect()]  # about ``wanted``
    # written, so that the joins below meet a plain column and not the search for it
    in_range = materialize(thin.withColumn("range", _range_of(F.col("key"), _splitters(sample, ranges))), "ranged-records")
    full = in_range.groupBy("range").agg(F.sum("size").alias("range_bytes"))  # one row per range
    parts = F.greatest(F.ceil(F.col("range_bytes") * ranges / F.lit(2.0 * max(n_bytes, 1))), F.lit(1))
    # fewer than GROUP_PART * shards keys can hold more than that part of a shard each
    large = (in_range.groupBy("key").agg(F.sum("size").alias("b"))
             .filter(F.col("b") * (GROUP_PART * shards) > n_bytes).select("key", F.lit(True).alias("large")))
    sub = F.when(F.col("large"), F.xxhash64("doc_id", F.lit("sub"))).otherwise(F.xxhash64("key", F.lit("sub")))
    dealt = (in_range.join(F.broadcast(full.select("range", parts.alias("parts"))), "range")
             .join(F.broadcast(large), "key", "left")
             .withColumn("sub", F.when(F.col("parts") > 1, F.pmod(sub, "parts")).otherwise(F.lit(0).cast("long")))
             .drop("parts", "large"))
    units = dealt.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    order = Window.orderBy("range", "sub")  # over the ranges, not the records
    starts = units.select("range", "sub", (F.sum("b").over(order) - F.col("b")).alias("bytes_before"),
                          (F.sum("r").over(order) - F.col("r")).alias("rows_before"))
    unit = Window.partitionBy("range", "sub").orderBy("key", "doc_id")
    running = unit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "sub", "key")
    at = (dealt.join(F.broadcast(starts), ["range", "sub"])
          .withColumn("at", F.col("bytes_before") + F.sum("size").over(running) - F.col("size"))
          .withColumn("row", F.col("rows_before") + F.row_number().over(unit) - 1)
          .withColumn("group_at", F.min("at").over(group))
          .withColumn("group_bytes", F.sum("size").over(group)))
    cut = F.col("group_bytes") * (GROUP_PART * shards) > n_bytes
    middle = F.when(cut, F.col("at") + F.col("size") / 2).otherwise(F.col("group_at") + F.col("group_bytes") / 2)
    placed = materialize(at.select(
        "doc_id", "size", "text_crc32", "row",
        F.least(F.floor(middle * F.lit(shards) / F.lit(max(n_bytes, 1))), F.lit(shards - 1)).cast("int")
        .alias("shard")), "placed-records")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")))


def sharding_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The assignment with its law: shards of near equal bytes."""
    return assign_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
