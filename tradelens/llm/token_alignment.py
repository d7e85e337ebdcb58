"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded by a byte-level BPE (A, with a space in front) and by a
sentence-piece model (B, which adds that space itself); both then spell the same bytes.

1. Tasks take the documents in slices of bounded size. A slice's tokens are two
   tables (document, byte where the token starts). ``pandas.merge_asof``, keyed
   by document, finds the other side's token that covers each token's start;
   the union of both directions is the overlap relation, and overlapping tokens
   with equal ends close a group.
2. All pairs of A and B tokens in a group are links. Each document keeps its
   distinct linked id pairs with multiplicities as arrays of numbers, and tasks
   combine (pair, documents that hold it) before the shuffle.
3. The commonest pairs (a bounded number, found by a histogram of the counts)
   are broadcast, and documents sum them where they lie; the other pairs are
   joined by a shuffle. The highest count of each A id has one row per entry of
   A's vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tradelens.llm.common import materialize, released, slices
from tradelens.llm.pretokens import byte_characters, tokenizer_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast at most (16 bytes each), and steps of the histogram per doubling.
HOT_PAIRS, STEPS = 1 << 20, 8
#: Links of groups that are expanded at once in a task; a larger group goes by its distinct ids.
LINKS_AT_ONCE = 1 << 21
#: Distinct pairs a task gathers before it passes them on.
COMBINE_PAIRS = 1 << 21


class TokenizerPair:
    """Both tokenizers, and the bytes that each id stands for."""

    def __init__(self, a: str, b: str):
        self._a = _byte_level(tokenizer_path(a))
        self._b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        self.n_a, self.n_b = self._a.n_vocab, self._b.vocab_size()
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("id pairs must fit 32 bits")
        self.bytes_a = [self._a.decode_single_token_bytes(i) for i in range(self.n_a)]
        self.bytes_b = [_piece_bytes(self._b, i) for i in range(self.n_b)]
        self.length_a = np.array([len(x) for x in self.bytes_a], "i8")
        self.length_b = np.array([len(x) for x in self.bytes_b], "i8")

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """(A's ids of space + text, B's ids of text); none if the text is NULL or empty, or if
        either side's bytes are not those of space + text."""
        if not text:
            return [], []
        spelled = b" " + text.encode("utf-8")
        a, b = self._a.encode_ordinary(" " + text), self._b.encode(text, num_threads=1)
        same = (b"".join(map(self.bytes_a.__getitem__, a)) == spelled
                and b"".join(map(self.bytes_b.__getitem__, b)) == spelled)
        return (a, b) if same else ([], [])


def _byte_level(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, in the faster library: same vocabulary and, as ids
    follow the order of the merges, same merges. Special strings are ordinary text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, vocab = {t["content"] for t in spec["added_tokens"]}, spec["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path}: only plain byte-level BPE files with ids in the order of merges are supported")
    byte_of = {c: b for b, c in byte_characters().items()}
    ranks = {bytes(byte_of[c] for c in symbols): i for symbols, i in vocab.items() if symbols not in added}
    return tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _piece_bytes(model: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode("utf-8")


@functools.lru_cache(maxsize=2)
def load_pair(a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> TokenizerPair:
    """One instance per Python worker."""
    return TokenizerPair(a, b)


@dataclass
class Aligned:
    """Tokens of a slice of documents, one side after the other, and their groups.

    ``group_*`` number the groups through the slice, ``end_*`` are bytes from the
    slice's start, ``doc_*`` the document in the slice; ``overlaps`` are pairs
    of token numbers.
    """

    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_doc: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray]


def align(texts: Sequence[str | None], pair: TokenizerPair) -> Aligned:
    """Aligns the tokens of some documents."""
    encoded = [pair.encode(t) for t in texts]
    sides = []
    for side, lengths in ((0, pair.length_a), (1, pair.length_b)):
        n = np.array([len(e[side]) for e in encoded], "i8")
        ids = np.fromiter(itertools.chain.from_iterable(e[side] for e in encoded), "i8", int(n.sum()))
        end = np.cumsum(lengths[ids])
        sides.append((ids, np.repeat(np.arange(len(encoded)), n), end - lengths[ids], end))
    (a, doc_a, start_a, end_a), (b, doc_b, start_b, end_b) = sides
    table_a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(a))})
    table_b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(b))})
    # both spell the same bytes from each document's first on, so every start is covered
    found_b = pd.merge_asof(table_a, table_b, on="at", by="doc")["b"].to_numpy("i8")
    found_a = pd.merge_asof(table_b, table_a, on="at", by="doc")["a"].to_numpy("i8")
    other = start_a[found_a] != start_b  # tokens that start together have found each other already
    left = np.concatenate([table_a["a"].to_numpy(), found_a[other]])
    right = np.concatenate([found_b, table_b["b"].to_numpy()[other]])
    closing = end_a[left] == end_b[right]
    closes_a, closes_b = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
    closes_a[left[closing]] = 1
    closes_b[right[closing]] = 1
    return Aligned(a, b, doc_a, doc_b, end_a, end_b, np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b,
                   doc_a[closes_a == 1], (left, right))


def _links(al: Aligned, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, pair, occurrences) of the links, in parts; a pair is a * n_b + b."""
    groups = len(al.group_doc)
    in_a, in_b = np.bincount(al.group_a, minlength=groups), np.bincount(al.group_b, minlength=groups)
    from_a, from_b, links = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a * in_b
    large = np.flatnonzero(links > LINKS_AT_ONCE)
    for g in large:
        ids_a, times_a = np.unique(al.a[from_a[g]:from_a[g] + in_a[g]], return_counts=True)
        ids_b, times_b = np.unique(al.b[from_b[g]:from_b[g] + in_b[g]], return_counts=True)
        step = max(1, LINKS_AT_ONCE // len(ids_b))
        for i in range(0, len(ids_a), step):
            pairs = (ids_a[i:i + step, None] * n_b + ids_b).ravel()
            yield np.full(len(pairs), al.group_doc[g]), pairs, np.outer(times_a[i:i + step], times_b).ravel()
    small = np.ones(groups, bool)
    small[large] = False
    chosen = np.flatnonzero(small[al.group_a])  # tokens of A whose group is expanded
    each = in_b[al.group_a[chosen]]
    total = np.cumsum(each)
    at = 0
    while at < len(chosen):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
        part, n = chosen[at:to], each[at:to]
        g = al.group_a[part]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.repeat(al.a[part] * n_b, n) + al.b[np.repeat(from_b[g], n) + inside]
        yield np.repeat(al.doc_a[part], n), pairs, np.ones(len(pairs), "i8")
        at = to


def linked_pairs(al: Aligned, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, occurrences), each document's distinct pairs in order."""
    keys, times = np.empty(0, "u8"), np.empty(0, "i8")
    for doc, pairs, n in _links(al, n_b):
        key = (doc.astype("u8") << np.uint64(32)) | pairs.astype("u8")
        key, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
        both = np.concatenate([times, n])
        times = np.zeros(len(key), "i8")
        np.add.at(times, at, both)
        keys = key
    return (keys >> np.uint64(32)).astype("i8"), (keys & np.uint64(0xFFFFFFFF)).astype("i8"), times


@functools.lru_cache(maxsize=2)
def _printed(n: int) -> list[np.ndarray]:
    """Each id's decimal digits followed by one of the separators."""
    return [np.array([f"{i}{s}" for i in range(n)], object) for s in ",|;"]


def group_texts(al: Aligned, docs: int, size: int) -> list[str]:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3`` (ids in order)."""
    comma, bar, semicolon = _printed(size)
    last_a = np.append(al.group_a[1:] != al.group_a[:-1], True)[:len(al.a)]
    last_b = np.append(al.group_b[1:] != al.group_b[:-1], True)[:len(al.b)]
    printed_a, printed_b = comma[al.a], comma[al.b]
    printed_a[last_a], printed_b[last_b] = bar[al.a[last_a]], semicolon[al.b[last_b]]
    order = np.argsort(np.concatenate([al.group_a * 2, al.group_b * 2 + 1]), kind="stable")
    printed = np.concatenate([printed_a, printed_b])[order].tolist()
    n = np.bincount(al.doc_a, minlength=docs) + np.bincount(al.doc_b, minlength=docs)
    ends = np.cumsum(n)
    return ["".join(printed[e - k:e])[:-1] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]


_DOCUMENT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def aligned_documents(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """One row per document: row (a key), doc_id, counts, checksum of its groups, and its distinct
    linked pairs (little-endian unsigned 32-bit) with their occurrences (64-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = load_pair(a, b), TaskContext.get().partitionId() << 40
        size = max(pair.n_a, pair.n_b)
        for part, texts in slices(batches):
            m = len(texts)
            al = align(texts, pair)
            groups = len(al.group_doc)
            links = np.bincount(al.group_a, minlength=groups) * np.bincount(al.group_b, minlength=groups)
            n_links = np.zeros(m, "i8")
            np.add.at(n_links, al.group_doc, links)
            doc, pairs, times = linked_pairs(al, pair.n_b)
            ends = np.cumsum(np.bincount(doc, minlength=m))
            begins = np.append(0, ends[:-1])
            pairs = pairs.astype("<u4")
            sums = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(al, m, size)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + m)), part.column(0), pa.array(np.bincount(al.doc_a, minlength=m)),
                pa.array(np.bincount(al.doc_b, minlength=m)), pa.array(np.bincount(al.group_doc, minlength=m)),
                pa.array(n_links), pa.array(sums, pa.string()),
                pa.array([pairs[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary()),
                pa.array([times[i:j].astype("<i8").tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary()),
            ], schema=_DOCUMENT)
            row += m

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        released(run), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                       "groups_sha256 string, pairs binary, times binary")


def align_tokens(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """One row per group: doc_id, number (in the document, from 0), start and end (bytes of space +
    text), a_ids, b_ids, overlaps (pairs of token places in the group).

    Needs ``doc_id`` and ``text``; other columns are ignored. NULL and empty
    texts, and texts that either tokenizer spells in other bytes (white space or
    characters that it changes), have no groups. Repeated rows come out as
    often as they occur; an empty table gives no groups.
    """
    schema = ("doc_id long, number long, start long, end long, a_ids array<int>, b_ids array<int>, "
              "overlaps array<struct<a:int,b:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load_pair(a, b)
        for part, texts in slices(batches):
            al = align(texts, pair)
            groups = len(al.group_doc)
            from_a = np.append(0, np.cumsum(np.bincount(al.group_a, minlength=groups))).astype("i4")
            from_b = np.append(0, np.cumsum(np.bincount(al.group_b, minlength=groups))).astype("i4")
            left, right = al.overlaps
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            of = al.group_a[left]
            pairs = pa.StructArray.from_arrays(
                [pa.array((left - from_a[of]).astype("i4")), pa.array((right - from_b[of]).astype("i4"))], ["a", "b"])
            from_pairs = np.append(0, np.cumsum(np.bincount(of, minlength=groups))).astype("i4")
            per_doc = np.bincount(al.group_doc, minlength=len(texts))
            ends = al.end_a[from_a[1:] - 1]
            base = np.repeat((lambda n: np.cumsum(n) - n)(_spelled_bytes(al, len(texts))), per_doc)
            starts = np.append(0, ends[:-1]) if groups else ends
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(al.group_doc)),
                pa.array(np.arange(groups) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)),
                pa.array(starts - base), pa.array(ends - base),
                pa.ListArray.from_arrays(pa.array(from_a), pa.array(al.a.astype("i4"))),
                pa.ListArray.from_arrays(pa.array(from_b), pa.array(al.b.astype("i4"))),
                pa.ListArray.from_arrays(pa.array(from_pairs), pairs),
            ], ["doc_id", "number", "start", "end", "a_ids", "b_ids", "overlaps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), schema)


def _spelled_bytes(al: Aligned, docs: int) -> np.ndarray:
    """Bytes that each document's tokens spell."""
    last = np.zeros(docs, "i8")
    last[al.doc_a] = al.end_a  # the last one stays
    filled = np.maximum.accumulate(last)
    return np.diff(filled, prepend=0)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether that is its A id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype("i8")), pa.array(n)], ["pair", "n"])

        known, n = np.empty(0, "u4"), np.empty(0, "i8")
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):  # each document's pairs are distinct
                more, times = np.unique(np.frombuffer(b"".join(
                    batch.column(0).slice(i, 2000).to_pylist()), "<u4"), return_counts=True)
                merged, at = np.unique(np.concatenate([known, more]), return_inverse=True)
                summed = np.zeros(len(merged), "i8")
                np.add.at(summed, at, np.concatenate([n, times]))
                known, n = merged, summed
                if len(known) >= COMBINE_PAIRS:
                    yield out(known, n)
                    known, n = known[:0], n[:0]
        yield out(known, n)

    counted = materialize(aligned.select("pairs").mapInArrow(released(run), "pair long, n long")
                          .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of_a = F.floor(F.col("pair") / n_b).cast("int")
    best = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # one row per entry of A's vocabulary
    return counted.withColumn("a", of_a).join(F.broadcast(best), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The commonest pairs, HOT_PAIRS at most: (pairs in order, counts, best)."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    histogram = sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True)
    least, total = 1 << 30, 0  # a histogram of logarithms: at most 64 * STEPS rows
    for r in histogram:
        if (total := total + r.c) > HOT_PAIRS:
            break
        least = r.s
    rows = counts.filter(step >= least).toArrow()
    pairs = rows.column("pair").to_numpy()
    order = np.argsort(pairs)
    return pairs[order].astype("u4"), rows.column("n").to_numpy()[order], rows.column("best").to_numpy()[order]


def alignment_digest(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are all pairs of an A and a B token of one group; a pair's count is the
    number of documents that hold it linked. n_best: links whose count is the
    highest of their A id; count_sum: the sum of the counts over the links;
    groups_sha256: checksum of ``a1,a2|b1;a3|b2,b3``. Needs ``doc_id`` and
    ``text``; other columns are ignored. Texts without tokens (NULL, empty, or
    spelled in other bytes) have zeros and an empty checksum. Every row is a
    document, also a repeated one or one without doc_id. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    aligned = materialize(aligned_documents(docs, a, b), "aligned")
    counts = materialize(pair_counts(aligned, load_pair(a, b).n_b), "pair-ranks")
    hot = spark.sparkContext.broadcast(_hot_pairs(counts))

    def looked_up(pairs: pa.Array, times: pa.Array):
        """(document, pair, occurrences, place among the hot pairs, whether it is there)."""
        each, known = [len(x) // 4 for x in pairs.to_pylist()], hot.value[0]
        flat = np.frombuffer(b"".join(pairs.to_pylist()), "<u4")
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        found = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        return (np.repeat(np.arange(len(each)), each), flat, np.frombuffer(b"".join(times.to_pylist()), "<i8"),
                at, found)

    def sum_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = hot.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                doc, _, times, at, found = looked_up(batch.column("pairs"), batch.column("times"))
                sums = np.zeros((2, batch.num_rows), "i8")
                np.add.at(sums[0], doc[found], times[found] * best[at[found]])
                np.add.at(sums[1], doc[found], times[found] * n[at[found]])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(sums[0]), pa.array(sums[1])],
                    [*batch.schema.names[:-2], "hot_best", "hot_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                doc, pairs, times, _, found = looked_up(batch.column("pairs"), batch.column("times"))
                rows = batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[doc[~found]]), pa.array(pairs[~found].astype("i8")), pa.array(times[~found])],
                    ["row", "pair", "times"])

    summed = aligned.mapInArrow(
        released(sum_hot), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                           "groups_sha256 string, hot_best long, hot_sum long")
    rare = (aligned.select("row", "pairs", "times").mapInArrow(released(others), "row long, pair long, times long")
            .join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"),
                 F.sum(F.col("times") * F.col("n")).alias("rare_sum")))
    zero = F.lit(0).cast("long")
    return summed.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("hot_best") + F.coalesce("rare_best", zero)).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("rare_sum", zero)).alias("count_sum"), "groups_sha256")
