"""Benchmark decontamination: SimHash of item-sized windows.

1. every item and every document is a sequence of five-word shingles (fewer
   words: one shingle). A document's windows have an item's number of words.
   A window sharing no shingle with any item has similarity 0, so windows are
   laid where the document has an item's shingle, at that item's alignment
   (found through a Bloom bitmap of the items' shingles, then exactly);
2. each window gets a 64-bit SimHash. Two fingerprints within ``RADIUS`` bits
   agree on at least one of ``RADIUS + 1`` blocks, so joining windows and
   items of one length on (block, bits) finds all pairs within the radius;
3. similar pairs may lie beyond the radius, since the fingerprint counts all
   shingles alike. A pair of similarity t holds t of the item's weight, so it
   shares one of the item's rarest shingles that hold more than 1 - t of its
   weight together: joining on those finds every pair beyond the radius;
4. each pair is verified by weighted shingle similarity. A shingle found in
   several items weighs less: 1 / number of those items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelens.llm.common import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Largest Hamming distance of a pair found by fingerprints (others: by rare shingles). Similar sequences (0.8)
#: differ in about 10 of 64 bits.
RADIUS = 15
#: Bits of the Bloom bitmap per item shingle; at least and at most this many bits (128 KB to 2 MB).
BLOOM_BITS, BLOOM_LEAST, BLOOM_MOST = 64, 1 << 20, 1 << 24


def _shingles(text: Column) -> tuple[Column, Column]:
    """(words, hashes of the five-word shingles of ``words``); the second reads a column ``words``."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE)]))
    return words, F.when(F.size("words") > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _simhash(hashes: str) -> Column:
    """64-bit SimHash: bit b is set when most hashes have it. Four 16-bit counters share a long.

    One expression for all bits: spelt out bit by bit it fills the driver with plans and generated code.
    """
    def lanes(g: Column):
        return lambda acc, h: acc + F.call_function("shiftrightunsigned", h, g).bitwiseAND(F.lit(0x0001000100010001))

    def bits(counts: Column, g: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for lane in range(4):
            count = F.shiftrightunsigned(counts, 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), g + 16 * lane)
            out = out.bitwiseOR(F.when(count * 2 > F.size(hashes), bit).otherwise(F.lit(0).cast("bigint")))
        return out

    zero = F.lit(0).cast("bigint")
    counts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.aggregate(hashes, zero, lanes(g)))
    return F.aggregate(F.transform(counts, bits), zero, lambda acc, x: acc.bitwiseOR(x))


def _blocks(fingerprint: Column) -> Column:
    """(block number, bits) of RADIUS + 1 blocks that cover all 64 bits."""
    count, start, parts = RADIUS + 1, 0, []
    for b in range(count):
        width = 64 // count + (1 if b < 64 % count else 0)
        bits = F.shiftrightunsigned(fingerprint, start).bitwiseAND(F.lit((1 << width) - 1))
        parts.append(F.struct(F.lit(b).alias("block"), bits.alias("bits")))
        start += width
    return F.array(*parts)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, length in words, shingles in order, fingerprint) of every item with a word."""
    words, hashes = _shingles(F.col("text"))
    return (benchmark.select("item_id", words.alias("words")).filter(F.size("words") > 0)
            .select("item_id", F.size("words").alias("length"), hashes.alias("shingles"))
            .withColumn("fingerprint", _simhash("shingles")))


def _bloom(shingles: DataFrame, bits: int) -> Column:
    """The items' shingles as a bitmap of two bits each: an array of longs, a scalar subquery."""
    spark = shingles.sparkSession
    slots = shingles.select(F.explode(F.array(*_slots(F.col("h"), bits))).alias("slot"))
    longs = slots.groupBy(F.shiftright("slot", 6).alias("k")).agg(
        F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    every = spark.range(bits >> 6).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("bits"))
    dense = longs.unionByName(every).groupBy("k").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "bits"))), lambda x: x.bits)).scalar()


def _slots(h: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("bigint")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def _in_bloom(h: Column, bits: int) -> Column:
    out = F.lit(True)
    for slot in _slots(h, bits):
        word = F.get("bloom", F.shiftright(slot, 6).cast("int"))
        out = out & (F.call_function(
            "shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs: doc_id, h (hash of the text), item_id, start and length of the window in words, similarity.

    Needs ``doc_id`` and ``text``, and ``item_id`` and ``text`` of the
    benchmark. NULL and empty texts and items match nothing. An item longer
    than a document is compared with the whole document. An empty table on
    either side gives no pairs.
    """
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    of_items = items.select("item_id", "length", F.posexplode("shingles").alias("j", "h"))
    n_shingles, longest = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)),
                                    F.coalesce(F.max("length"), F.lit(0))).first()
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_BITS * n_shingles).bit_length()))

    words, hashes = _shingles(F.col("text"))
    hashed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h_text"),
                          words.alias("words"), _bloom(of_items, bits).alias("bloom"))
              .withColumn("shingles", hashes).withColumn("n_words", F.size("words")))
    marked = F.filter(F.transform("shingles", lambda h, i: F.struct(h.alias("h"), i.alias("i"))),
                      lambda x: _in_bloom(x.h, bits))
    # what surrounds a mark: as far as any window through it reaches
    around = F.transform(marked, lambda x: F.struct(
        x.h.alias("h"), x.i.alias("i"), F.greatest(x.i - longest, F.lit(0)).alias("from_i"),
        F.slice("shingles", F.greatest(x.i - longest, F.lit(0)) + 1, F.lit(2 * longest + 1)).alias("near")))
    marks = hashed.select("doc_id", "h_text", "n_words", F.explode(around).alias("m")).select(
        "doc_id", "h_text", "n_words", "m.*")
    window_start = F.greatest(F.least(F.col("i") - F.col("j"), F.col("n_words") - F.col("length")), F.lit(0))
    windows = (marks.join(of_items.select("h", "length", "j").distinct(), "h")
               .withColumn("start", window_start)
               .select("doc_id", "h_text", "length", "start", F.slice(
                   "near", F.col("start") - F.col("from_i") + 1,
                   F.greatest(F.col("length") - (SHINGLE - 1), F.lit(1))).alias("shingles"))
               .dropDuplicates(["doc_id", "h_text", "length", "start"]))
    windows = materialize(windows.withColumn("fingerprint", _simhash("shingles"))
                          .withColumn("window", F.monotonically_increasing_id()), "windows")

    held_by = of_items.groupBy("h").agg(F.countDistinct("item_id").alias("held_by"))
    # what depends on the items alone is written once: the plans over the windows stay small in the driver
    weighed = materialize(of_items.select("item_id", "length", "h").distinct().join(held_by, "h")
                          .withColumn("w", 1 / F.col("held_by")), "benchmark-shingles")
    weights = weighed.groupBy("item_id").agg(F.collect_list(F.struct("h", "w")).alias("weighed"))
    right = materialize(items.join(weights, "item_id").select(
        "item_id", "length", F.col("fingerprint").alias("item_fingerprint"), "weighed"), "benchmark-weights")
    blocks = (right.withColumn("b", F.explode(_blocks(F.col("item_fingerprint"))))
              .select("*", "b.block", "b.bits").drop("b"))
    left = (windows.withColumn("b", F.explode(_blocks(F.col("fingerprint"))))
            .select("doc_id", "h_text", "length", "start", "fingerprint", "shingles", "b.block", "b.bits"))
    near = left.join(blocks, ["length", "block", "bits"])
    difference = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    # a pair that agrees on several blocks is kept at the first of them
    first = F.array_position(F.transform(_blocks(difference), lambda x: x.bits == 0), True) - 1
    near = near.filter((F.bit_count(difference) <= RADIUS) & (first == F.col("block")))
    near = near.select("doc_id", "h_text", "length", "start", "shingles", "item_id", "weighed").unionByName(
        _beyond_radius(windows, right, weighed, similarity))
    near = near.withColumn("seen", F.array_distinct("shingles"))
    item_weight = F.aggregate("weighed", F.lit(0.0), lambda acc, x: acc + x.w)
    shared = F.aggregate(F.filter("weighed", lambda x: F.array_contains("seen", x.h)), F.lit(0.0),
                         lambda acc, x: acc + x.w)
    foreign = F.size(F.array_except("seen", F.transform("weighed", lambda x: x.h)))
    near = near.withColumn("item_weight", item_weight).withColumn(
        "similarity", shared / (F.col("item_weight") + foreign * F.col("item_weight") / F.size("weighed")))
    # sums of the same weights in another order may differ in the last bits
    return (near.filter(F.col("similarity") >= similarity - 1e-9)
            .select("doc_id", F.col("h_text").alias("h"), "item_id", "start", "length", "similarity"))


def _beyond_radius(windows: DataFrame, items: DataFrame, weighed: DataFrame, similarity: float) -> DataFrame:
    """All pairs of more than RADIUS bits that share one of the item's rarest shingles: those before which less
    than 1 - similarity of the item's weight stands."""
    item = Window.partitionBy("item_id")
    running = item.orderBy("held_by", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = (weighed.withColumn("before", F.sum("w").over(running) - F.col("w")).withColumn("all", F.sum("w").over(item))
            .filter(F.col("before") <= (1 - similarity + 1e-6) * F.col("all")).select("item_id", "length", "h")
            .join(items.select("item_id", "item_fingerprint"), "item_id"))
    difference = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    pairs = (windows.select("window", "length", "fingerprint", F.explode(F.array_distinct("shingles")).alias("h"))
             .join(rare, ["length", "h"]).filter(F.bit_count(difference) > RADIUS).select("window", "item_id").distinct())
    return (materialize(pairs, "rare-pairs").join(windows, "window").join(items.select("item_id", "weighed"), "item_id")
            .select("doc_id", "h_text", "length", "start", "shingles", "item_id", "weighed"))


def judge_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, and the most similar item (ties: the
    smallest id) with the start and length of its window (in words) and its similarity; NULL without one."""
    leaks = find_leaks(docs, benchmark)
    best = F.max(F.struct("similarity", (-F.col("item_id")).alias("i"), (-F.col("start")).alias("s"), "length"))
    found = materialize(leaks.groupBy("doc_id", "h").agg(
        F.countDistinct("item_id").alias("n_items"), best.alias("best")).select(
        "doc_id", "h", "n_items", (-F.col("best.i")).alias("item_id"), F.col("best.similarity").alias("similarity"),
        (-F.col("best.s")).alias("start"), F.col("best.length").alias("length")), "leaks")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    same = thin["doc_id"].eqNullSafe(found["doc_id"]) & (thin["h"] == found["h"])
    return thin.join(found, same, "left").select(
        thin["doc_id"], F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "similarity", "start", "length")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, all columns as they are."""
    found = materialize(find_leaks(docs, benchmark).select("doc_id", "h").distinct(), "leaking-documents")
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["h"])
    return docs.join(found, same, "left_anti")
