"""Packing: concatenate and cut.

Documents are laid end to end in the order in which Spark reads them and the
row of tokens is cut every ``length`` tokens, so only the last sequence can
have padding. Two passes give each document its place:

1. each partition turns its documents into ids and keeps a running sum, the
   start inside the partition; this table is written to the shared folder;
2. a prefix sum over the partitions' totals (one row per partition) gives
   each partition its global offset. A document whose tokens cross a cut
   becomes several pieces: its boundary records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tradelens.llm.common import materialize, released, text_or_empty
from tradelens.llm.pretokens import DEFAULT_TOKENIZER, load_tokens

#: Pre-tokens whose ids a worker remembers before it starts anew (bounded memory).
REMEMBERED = 300_000


class _Ids(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ids):
        super().__init__()
        self._ids = ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = np.asarray(self._ids(piece), "<u4").tobytes()
        return out


def tokenize(docs: DataFrame, end_id: int = 1, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, part, start_in_part, doc_tokens, ids) of every document, ``end_id`` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = load_tokens(tokenizer), np.asarray([end_id], "<u4").tobytes()
        known, part, at = _Ids(tokens.ids), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [b"".join(map(known.__getitem__, tokens.split(t))) + end for t in batch.column(1).to_pylist()]
            n = np.fromiter((len(x) // 4 for x in ids), "i8", len(ids))
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, "i8")), pa.array(starts), pa.array(n),
                 pa.array(ids, pa.binary())],
                ["doc_id", "part", "start_in_part", "doc_tokens", "ids"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(released(run), "doc_id long, part long, start_in_part long, doc_tokens long, ids binary"))


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the
    sequence), continued (the piece starts inside its document), continues.

    Needs ``doc_id`` and ``text``; other columns are ignored. A NULL or empty
    text is the end id alone. Repeated rows are packed as often as they
    occur. An empty table gives no pieces. The order of documents, hence the
    layout, follows the partitions of ``docs``.
    """
    written = materialize(tokenize(docs, end_id, tokenizer), "tokens")
    totals = written.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # one row per input partition, so this window and broadcast are bounded by the number of tasks
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = written.join(F.broadcast(before), "part").withColumn("g", F.col("before") + F.col("start_in_part"))
    cuts = F.transform(
        F.sequence(F.floor(F.col("g") / length), F.floor((F.col("g") + F.col("doc_tokens") - 1) / length)),
        lambda s: F.struct(s.alias("sequence_id"),
                           F.greatest(F.col("g"), s * length).alias("lo"),
                           F.least(F.col("g") + F.col("doc_tokens"), (s + 1) * length).alias("hi")))
    # the slices are taken before explode, so that no row repeats a whole document
    pieces = F.transform(cuts, lambda c: F.struct(
        (c.lo - F.col("g")).alias("start"), (c.hi - c.lo).alias("length"),
        F.substring(F.col("ids"), ((c.lo - F.col("g")) * 4 + 1).cast("int"), ((c.hi - c.lo) * 4).cast("int"))
        .alias("ids"), c.sequence_id.alias("sequence_id"), (c.lo - c.sequence_id * length).alias("offset")))
    return (placed.select("doc_id", "doc_tokens", F.explode(pieces).alias("p"))
            .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset",
                    (F.col("p.start") > 0).alias("continued"),
                    (F.col("p.start") + F.col("p.length") < F.col("doc_tokens")).alias("continues")))


def packed_digest(docs: DataFrame, length: int = 2048) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, length).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "continued", "continues")
