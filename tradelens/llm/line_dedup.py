"""Line dedup: winnowing over line hashes.

A document is its sequence of lines with a word. A gram is the shortest run
of lines from some line on with ``GRAM_WORDS`` words; a window is the shortest
run with ``WINDOW_WORDS`` words from some line on, or up to some line. Each
window selects the gram of least hash among those inside it, so two documents
that share a run of ``WINDOW_WORDS`` words or more share a selected gram: a
guaranteed fingerprint.

1. every selected gram's first position in the corpus (by doc_id, then line)
   is found by a pre-aggregated minimum;
2. each later position is joined with the first one, and the match is
   extended both ways, line by line. A fingerprint carries the lines around
   it as far as ``WINDOW_WORDS`` words;
3. the gram's first position may stand among other lines than a later match
   of two positions, so the windows that selected a repeated gram are grouped
   by the hash of all their lines, and those equal to an earlier window are
   found in the same way. Every line of a run of ``WINDOW_WORDS`` words lies
   in a window inside the run: a repeated run goes whole, whichever documents
   hold its parts;
4. the lines of later runs and windows go. A line only goes when an equal one
   stands at an earlier place, so every text keeps its first occurrence.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tradelens.llm.common import bitmap_of, materialize, released, split_by_bitmap, text_or_empty

GRAM_WORDS, WINDOW_WORDS = 30, 50

_FINGERPRINT = ("doc_id long, h long, pos int, gram long, gram_lines array<int>, before array<long>, "
                "before_lines array<int>, after array<long>, after_lines array<int>, window array<long>, "
                "window_before array<int>, window_after array<int>")


def _run_end(words: list[int], least: int) -> list[int]:
    """For each start the end (exclusive) of the shortest run with ``least`` words; 0 if there is none."""
    out, end, total = [], 0, 0
    for start, n in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        out.append(end if total >= least else 0)
        total -= n
    return out


def fingerprints(text: str, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> list[tuple]:
    """(pos, gram, gram_lines, before, before_lines, after, after_lines, window, window_before, window_after)
    of each selected gram; ``*_lines`` are line numbers, ``before`` is nearest first. The last three: hash and
    lines before and after the gram of each window that selected it."""
    numbers, hashes, words = [], [], []
    for number, line in enumerate(text.split("\n")):
        of_line = line.encode("utf-8").split()
        if of_line:
            numbers.append(number)
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(of_line)) - (1 << 63))
            words.append(len(of_line))
    gram_end, window_end = _run_end(words, gram_words), _run_end(words, window_words)
    grams = [xxhash.xxh3_64_intdigest(repr(hashes[i:e])) - (1 << 63) if e else 0 for i, e in enumerate(gram_end)]
    window_start = _run_end(words[::-1], window_words)[::-1]  # the same from the end, counted from there
    windows = {(start, end) for start, end in enumerate(window_end) if end}
    windows |= {(len(words) - start, end) for end, start in enumerate(window_start, 1) if start}
    selected, lines = defaultdict(list), array("q", hashes).tobytes()
    for start, end in sorted(windows):
        inside = [i for i in range(start, end) if gram_end[i] and gram_end[i] <= end]
        selected[min(inside, key=lambda i: (grams[i], -i))].append((start, end))
    out = []
    for i in sorted(selected):
        e, a, total = gram_end[i], i, 0
        while a > 0 and total < window_words:
            a -= 1
            total += words[a]
        b, total = e, 0
        while b < len(words) and total < window_words:
            total += words[b]
            b += 1
        out.append((i, grams[i], numbers[i:e], hashes[a:i][::-1], numbers[a:i][::-1], hashes[e:b], numbers[e:b],
                    [xxhash.xxh3_64_intdigest(lines[8 * start:8 * end]) - (1 << 63) for start, end in selected[i]],
                    [i - start for start, _ in selected[i]], [end - e for _, end in selected[i]]))
    return out


def _all_fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), ints, longs, ints, longs, ints, longs, ints, ints]
        names = [part.split()[0] for part in _FINGERPRINT.split(", ")]
        for batch in batches:
            rows = [(doc_id, h, *f) for doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for f in fingerprints(text)]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(*_key(), text_or_empty().alias("text")).mapInArrow(released(run), _FINGERPRINT)


def _key() -> tuple[Column, Column]:
    """What identifies a document here: its id (NULL before all others) and its text's hash."""
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
            F.xxhash64(text_or_empty()).alias("h"))


def _common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, gone): the line numbers of later repeated runs, for documents that have any."""
    found = _all_fingerprints(docs)
    first = (found.groupBy("gram").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"), F.count(F.lit(1)).alias("c"))
             .filter(F.col("c") > 1).select("gram", "first"))
    repeated = materialize(
        found.join(first, "gram").withColumn("is_first", F.struct("doc_id", "h", "pos") == F.col("first")).drop("first"),
        "repeated-fingerprints")
    sources = (repeated.filter("is_first").dropDuplicates(["gram"])  # repeated rows of one document are one
               .select("gram", F.col("before").alias("first_before"), F.col("after").alias("first_after")))
    matched = repeated.filter(~F.col("is_first")).join(sources, "gram")
    extended = matched.select("doc_id", "h", _around(_common_prefix(F.col("before"), F.col("first_before")),
                                                     _common_prefix(F.col("after"), F.col("first_after"))))
    return (extended.unionByName(_repeated_windows(repeated)).groupBy("doc_id", "h")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))


def _around(before: Column, after: Column) -> Column:
    """The line numbers of a gram and of so many lines before and after it."""
    return F.concat("gram_lines", F.slice("before_lines", F.lit(1), before),
                    F.slice("after_lines", F.lit(1), after)).alias("gone")


def _repeated_windows(repeated: DataFrame) -> DataFrame:
    """(doc_id, h, gone) of each window that has an equal one at an earlier place."""
    each = F.inline(F.arrays_zip("window", "window_before", "window_after"))
    windows = repeated.select("doc_id", "h", "pos", "gram_lines", "before_lines", "after_lines", each)
    at = F.struct("doc_id", "h", (F.col("pos") - F.col("window_before")).alias("start"))
    first = (windows.groupBy("window").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c"))
             .filter(F.col("c") > 1).select("window", "first"))
    later = windows.select("doc_id", "h", "window", at.alias("at"), _around(F.col("window_before"), F.col("window_after")))
    return later.join(first, "window").filter(F.col("at") > F.col("first")).select("doc_id", "h", "gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with later repeated runs of lines deleted from ``text``,
    and ``gone``: the numbers (from 0) of the deleted lines, NULL where nothing was deleted.

    Needs ``doc_id`` and ``text``. NULL and empty texts stay as they are. No
    document is dropped; one that repeats others entirely is left with an
    empty text. Rows equal in doc_id and text are one document and treated
    alike. An empty table gives an empty result.
    """
    docs = docs.drop("gone")
    gone = materialize(repeated_lines(docs), "repeated-lines").select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "gone")
    doc_id, h = _key()
    key = F.xxhash64("__id", "__h")
    marked = docs.withColumn("__id", doc_id).withColumn("__h", h)
    hit, rest = split_by_bitmap(marked, key, bitmap_of(gone, key))  # only texts that lose lines are shuffled
    joined = hit.join(gone.hint("merge"), ["__id", "__h"], "left").drop("__id", "__h")
    at = joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text if lines is None else _without(text, set(lines)) for text, lines in zip(
                batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    whole = rest.drop("__id", "__h").withColumn("gone", F.lit(None).cast("array<int>"))
    return whole.unionByName(joined.mapInArrow(released(run), joined.schema))


def _without(text: str, gone: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (of the whole text), n_deleted, deleted (line numbers), text that is left."""
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"),
                      F.coalesce("gone", F.array().cast("array<int>")).alias("deleted"), "text")
