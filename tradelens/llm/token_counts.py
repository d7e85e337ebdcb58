"""Token counts: count pieces once per distinct pre-token, join, sum.

1. every text is split into pre-tokens; tasks combine them to (piece, count)
   and a shuffle leaves one row per distinct pre-token of the corpus;
2. each distinct pre-token is run through the BPE merges once: its number of
   tokens;
3. the per-document pre-token frequencies are joined with that table and
   summed. The most frequent pre-tokens (at most a fixed number of them, so the
   broadcast is bounded; they are the hot keys of the join) are summed where
   the text is read, the others are joined by a shuffle. Which ones these are
   follows from a histogram of their counts, not from a sort. No id list of a
   document is ever built.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradelens.llm.common import materialize, text_or_empty
from tradelens.llm.pretokens import DEFAULT_TOKENIZER, load_tokens

#: Pre-tokens whose counts are broadcast, and the longest of them (bytes): at most 32 MB.
HOT_PIECES = 1 << 19
HOT_BYTES = 64
#: Steps of that histogram per doubling of the count (63 doublings at most).
STEPS = 16
#: Distinct pre-tokens a task gathers before it passes them on.
COMBINE_PIECES = 500_000


def distinct_pieces(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(piece, n): every distinct pre-token of ``docs.text`` and how often it occurs."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = load_tokens(tokenizer).split, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text))
                if len(seen) >= COMBINE_PIECES:
                    yield out()
                    seen.clear()
        yield out()

    texts = docs.select(text_or_empty().alias("text"))
    return (texts.mapInArrow(pieces, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")))


def count_pieces(pieces: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Adds ``tokens``: the number of tokens of each distinct pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = load_tokens(tokenizer).ids
        for batch in batches:
            tokens = [len(ids(p)) for p in batch.column(0).to_pylist()]
            yield batch.append_column("tokens", pa.array(tokens, pa.int32()))

    return pieces.mapInArrow(count, "piece string, n long, tokens int")


def hot_pieces(table: DataFrame) -> DataFrame:
    """The rows of (piece, n, tokens) with the highest counts: as many whole steps of the histogram
    from the top as hold HOT_PIECES rows at most. Long pieces stay outside."""
    short = table.filter(F.octet_length("piece") <= HOT_BYTES).withColumn(
        "step", F.floor(F.log2("n") * STEPS).cast("int"))
    held = short.groupBy("step").agg(F.count(F.lit(1)).alias("c")).toArrow()  # at most 63 * STEPS rows
    least, total = None, 0
    for step, c in sorted(zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True), reverse=True):
        total += c
        if total > HOT_PIECES:
            break
        least = step
    return short.filter(F.col("step") >= least if least is not None else F.lit(False)).drop("step")


def count_tokens(docs: DataFrame, limit: int = 1024, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Needs ``doc_id`` and ``text``; other columns are ignored. A NULL or empty
    text has 0 bytes and 0 tokens. Repeated rows come out as often as they
    went in, also with a NULL doc_id. An empty table gives an empty result.
    Special strings inside a text are one token, as the library has it.
    """
    spark = docs.sparkSession
    table = materialize(count_pieces(distinct_pieces(docs, tokenizer), tokenizer), "piece-tokens")
    # the hot keys: at most HOT_PIECES rows of at most HOT_BYTES bytes reach the driver
    hot_rows = hot_pieces(table).select("piece", "tokens").toArrow()
    hot = spark.sparkContext.broadcast(
        dict(zip(hot_rows.column(0).to_pylist(), hot_rows.column(1).to_pylist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = load_tokens(tokenizer).split, hot.value
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()),
                            ("copies", pa.int64()), ("tokens", pa.int64()), ("piece", pa.string()),
                            ("n", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, total = Counter(split(text)), 0
                for piece, n in found.items():
                    tokens = known.get(piece)
                    if tokens is None:
                        rows.append((doc_id, h, 0, 0, 0, piece, n))
                    else:
                        total += n * tokens
                rows.append((doc_id, h, len(text.encode("utf-8")), 1, total, None, 0))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    per_piece = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"),
    ).mapInArrow(frequencies, "doc_id long, h long, n_bytes long, copies long, tokens long, piece string, n long")
    rare = (per_piece.filter(F.col("piece").isNotNull())
            .join(table.select("piece", F.col("tokens").cast("long").alias("of_piece")), "piece")
            .groupBy("doc_id", "h")
            .agg(F.sum(F.col("n") * F.col("of_piece")).alias("tokens"))
            .select("doc_id", "h", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("copies"),
                    "tokens"))
    known = per_piece.filter(F.col("piece").isNull()).select(rare.columns)
    # equal rows (same id, same text) fall together here and are told apart again by their number
    summed = known.unionByName(rare).groupBy("doc_id", "h").agg(
        F.sum("copies").alias("copies"), F.sum("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"))
    return (summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", (F.col("n_bytes") / F.col("copies")).cast("long").alias("n_bytes"),
                    (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
