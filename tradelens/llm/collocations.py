"""Phrase collocations by prefix-free parsing.

1. Each piece of a text (a run of words between punctuation) is parsed into
   chunks: a window of ``longest - 1`` words whose hash is 0 modulo ``PERIOD``
   triggers a cut, and the window belongs to the chunks on both sides. Cuts
   depend on the words alone, so repeated passages become the same chunks
   wherever they stand. The dictionary has each distinct chunk once, with the
   number of its places in the parse.
2. Phrases are counted inside the distinct chunks, weighted by these numbers. A
   phrase belongs to the chunk in which it starts before the closing window, so
   overlaps count once; in a piece's last chunk every start counts.
3. Counting goes by length. A phrase is as frequent as its parts at most, so only
   phrases whose parts (all but the last and all but the first word) passed are
   counted; a bitmap of fixed size tells them. Longer phrases are counted twice: first
   as 64-bit numbers, which can only be too frequent where two share one, then those
   that may be frequent as text, exactly. What a bitmap lets through by chance is
   counted and dropped.
4. Frequent phrases are joined with their cuts' parts and scored in exact
   integers; the best of each language leave by a window that keeps a bounded number per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tradelens.llm.common import BITMAP_BITS, bitmap_of, materialize, released, slices

#: A window of words in PERIOD triggers a cut, on average.
PERIOD = 24
#: Distinct phrases and numbers a task gathers before it passes them on.
COMBINE_PHRASES, COMBINE_NUMBERS = 1_000_000, 1 << 21
#: Chunks that a task looks at together.
CHUNKS_AT_ONCE = 50_000

#: Of each byte: 0 in a word, 1 between words, 2 between pieces; and its lower case (A-Z alone).
_KIND, _LOWER = np.zeros(256, "u1"), np.arange(256, dtype="u1")
_KIND[list(b" \t")], _KIND[list(b".,;:!?\n\v\f\r")] = 1, 2
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20130))
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, 16, "u8") | np.uint64(1)


def _word_hashes(spelled: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 bits of each word, as unsigned 64-bit numbers. ``spelled``: the bytes of the words, a space after each;
    ``ends``: where they end, their space included."""
    if not len(ends):
        return np.empty(0, "u8")
    starts = np.append(0, ends[:-1])
    size = ends - starts
    powers = np.full(int(size.max()), _MULTIPLIERS[14], "u8")
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inside = np.arange(len(spelled)) - np.repeat(starts, size)
    out = np.add.reduceat((spelled.astype("u8") + np.uint64(1)) * powers[inside], starts)
    out ^= out >> np.uint64(32)
    out *= _MULTIPLIERS[13]
    return out >> np.uint64(32)


def _window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash per run of ``width`` words, by the place of its first word."""
    m = max(len(words) - width + 1, 0)
    out = np.full(m, width, "u8")
    for i in range(width):
        out = (out ^ words[i:m + i]) * _MULTIPLIERS[i]
        out ^= out >> np.uint64(29)
    return out


def _split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts: (their bytes, A-Z lower-cased and a space after each; where each ends, its space
    included; the number of its piece, rising; the number of its text)."""
    encoded = [(text or "").encode("utf-8") for text in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*encoded, b""]), "u1")]  # a text's end ends its piece
    kind = _KIND[data]
    in_word = kind == 0
    edges = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    if len(in_word) and in_word[0]:
        edges = np.append(0, edges)
    starts, stops = edges[0::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in encoded]), starts, "right")
    data[stops], in_word[stops] = 32, True
    return data[in_word], np.cumsum(stops - starts + 1), piece, text


def _chunks(texts: list[str | None], overlap: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of some texts, in order: (words joined by spaces, whether it ends its piece, number of its text).

    Neighbouring chunks of a piece share ``overlap`` words, a trigger window.
    """
    spelled, word_ends, piece, text = _split(texts)
    if not len(word_ends):
        return pa.array([], pa.string()), np.empty(0, bool), np.empty(0, "i8")
    starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    ends = np.append(starts[1:], len(piece))
    triggers = np.flatnonzero(_window_hashes(_word_hashes(spelled, word_ends), overlap) % np.uint64(PERIOD) == 0)
    at = np.searchsorted(ends, triggers, "right")
    triggers = triggers[(triggers > starts[at]) & (triggers + overlap <= ends[at])]  # inside one piece
    cuts = np.union1d(starts, triggers)
    at = np.searchsorted(ends, cuts, "right")
    last = np.append(at[1:] != at[:-1], True)
    until = np.where(last, ends[at], np.append(cuts[1:], 0) + overlap)
    begin = np.append(0, word_ends)[cuts]
    size = word_ends[until - 1] - 1 - begin
    offsets = np.append(0, np.cumsum(size))
    taken = spelled[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
    chunks = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])
    return chunks.cast(pa.string()), last, text[cuts]


def pieces_of(text: str | None) -> list[list[str]]:
    """The pieces of a text that have words, as lists of words, A-Z lower-cased."""
    spelled, _, piece, _ = _split([text])
    out: dict[int, list[str]] = {}
    for number, word in zip(piece.tolist(), spelled.tobytes().decode("utf-8").split(" "), strict=False):
        out.setdefault(number, []).append(word)
    return list(out.values())


def parse(pieces: list[list[str]], overlap: int) -> list[tuple[str, bool]]:
    """The chunks of some pieces, in order: (words joined by spaces, whether it ends its piece)."""
    chunks, last, _ = _chunks([" ".join(words) for words in pieces], overlap)
    return list(zip(chunks.to_pylist(), last.tolist(), strict=True))


def chunk_dictionary(docs: DataFrame, longest: int) -> DataFrame:
    """(lang, chunk, last, places): each distinct chunk and how often it occurs in the parse."""
    names = ["lang", "chunk", "last", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            chunks, last, text = _chunks(texts, longest - 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), chunks, pa.array(last), pa.array(np.ones(len(last), "i8"))], names)

    return (docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
            .mapInArrow(released(run), "lang string, chunk string, last boolean, places long")
            .groupBy("lang", "chunk", "last").agg(F.sum("places").alias("places")))


def _starts(words: np.ndarray, last: np.ndarray, overlap: int) -> np.ndarray:
    """How many phrase starts belong to chunks of so many words."""
    return np.where(last, words, words - overlap)


def word_totals(dictionary: DataFrame, longest: int) -> DataFrame:
    """(lang, total): all word occurrences of each language."""
    words = F.length("chunk") - F.length(F.replace("chunk", F.lit(" "), F.lit(""))) + 1
    starts = F.when(F.col("last"), words).otherwise(words - (longest - 1))
    return dictionary.groupBy("lang").agg(F.sum(starts * F.col("places")).cast("long").alias("total"))


def _words_of(chunks: pa.Array) -> pa.ListArray:
    return pc.split_pattern(chunks.cast(pa.large_string()), " ")


def _hashes_of(chunks: pa.Array) -> pa.Array:
    """32 bits (little-endian) of each of a chunk's words."""
    if not len(chunks):
        return pa.array([], pa.binary())
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(chunks.cast(pa.large_string()), empty, space)  # a space after each word
    spelled = np.frombuffer(_joined(spaced), "u1")
    word_ends = np.flatnonzero(spelled == 32) + 1
    hashes = _word_hashes(spelled, word_ends).astype("<u4")
    ends = np.append(0, np.searchsorted(word_ends, np.cumsum(pc.binary_length(spaced).to_numpy()), "right") * 4).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(ends), pa.py_buffer(hashes)])


def with_hashes(dictionary: DataFrame) -> DataFrame:
    """The dictionary with ``hashes``: 32 bits (little-endian) of each of a chunk's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("hashes", _hashes_of(batch.column(1)))

    return dictionary.select("lang", "chunk", "last", "places").mapInArrow(
        released(run), "lang string, chunk string, last boolean, places long, hashes binary")


def _joined(column: pa.Array) -> memoryview:
    """The bytes of a column's values, one after the other."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "i8")[column.offset:column.offset + len(column) + 1] if len(column) else [0, 0]
    return memoryview(data or b"")[ends[0]:ends[-1]]


def _long_enough(dictionary: DataFrame, width: int) -> DataFrame:
    """The chunks of ``width`` words and more; no phrase of that length starts in others."""
    return dictionary.filter(F.octet_length("hashes") >= 4 * width)


class _Places:
    """The places of a batch of chunks where phrases of ``width`` words start."""

    def __init__(self, langs: pa.Array, last: np.ndarray, hashes: pa.Array, width: int, longest: int):
        length = pc.binary_length(hashes).to_numpy().astype("i8") // 4
        self._owner = np.repeat(np.arange(len(hashes)), length)
        self._words = np.frombuffer(_joined(hashes), "<u4").astype("u8")
        coded = langs.dictionary_encode()
        numbers = [xxhash.xxh3_64_intdigest(lang) for lang in coded.dictionary.to_pylist()]
        self._lang = np.array(numbers, "u8")[coded.indices.to_numpy()]
        starts = np.minimum(_starts(length, last, longest - 1), length - width + 1)
        inside = np.arange(len(self._words)) - np.repeat(np.cumsum(length) - length, length)
        self.at = np.flatnonzero(inside < starts[self._owner])

    @property
    def chunk(self) -> np.ndarray:
        return self._owner[self.at]

    def keys(self, width: int, shift: int = 0) -> np.ndarray:
        """A number per place for the ``width`` words from there (or so many words later) on."""
        found = _window_hashes(self._words, width)[self.at + shift]
        return (found ^ self._lang[self.chunk]) * _MULTIPLIERS[15]

    def keep(self, bitmap: np.ndarray, keys: np.ndarray) -> None:
        slot = (keys & np.uint64(BITMAP_BITS - 1)).astype("i8")
        self.at = self.at[((bitmap[slot >> 6] >> (slot & 63).astype("u8")) & np.uint64(1)).astype(bool)]


def _summed(keys: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    keys, group = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), "i8")
    np.add.at(out, group, f)
    return keys, out


def may_be_frequent(dictionary: DataFrame, width: int, longest: int, passed: np.ndarray, least: int) -> DataFrame:
    """(key) of phrases of ``width`` words that may occur ``least`` times, among those both of whose parts
    are in the bitmap ``passed``. Counts numbers only."""
    shared = dictionary.sparkSession.sparkContext.broadcast(passed)
    at_once, combine = CHUNKS_AT_ONCE, COMBINE_NUMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))

        def out(keys: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(f)], ["key", "f"])

        gathered = [(np.empty(0, "u8"), np.empty(0, "i8"))]
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                lang, last, times, hashes = (c.slice(i, at_once) for c in batch.columns)
                places = _Places(lang, last.to_numpy(zero_copy_only=False), hashes, width, longest)
                for shift in (0, 1):
                    if len(places.at):
                        places.keep(shared.value, places.keys(width - 1, shift))
                if not len(places.at):
                    continue
                gathered.append((places.keys(width), times.to_numpy()[places.chunk]))
                if sum(len(k) for k, _ in gathered) >= combine:
                    gathered = [merged(gathered)]
                    if len(gathered[0][0]) >= combine // 2:
                        yield out(*gathered[0])
                        gathered = [(np.empty(0, "u8"), np.empty(0, "i8"))]
        yield out(*merged(gathered))

    return (_long_enough(dictionary, width).select("lang", "last", "places", "hashes")
            .mapInArrow(released(run), "key long, f long")
            .groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("key"))


def _phrases_once(lang: pa.Array, phrase: pa.Array, f: np.ndarray, owner: np.ndarray | None = None,
                  at: np.ndarray | None = None) -> pa.Table:
    """(lang, phrase, f): each phrase once, with the sum of its counts; summed by numbers of its language and itself.
    With ``owner`` and ``at``: of the phrases at those places, ``owner`` being the place of their language."""
    lang, phrase = lang.dictionary_encode(), phrase.dictionary_encode()
    of_lang, of_phrase = lang.indices.to_numpy().astype("i8"), phrase.indices.to_numpy()
    if owner is not None:
        of_lang, of_phrase = of_lang[owner], of_phrase[at]
    code, f = _summed(of_lang * max(len(phrase.dictionary), 1) + of_phrase, f)
    of_lang, of_phrase = np.divmod(code, max(len(phrase.dictionary), 1))
    return pa.table({"lang": lang.dictionary.take(pa.array(of_lang)),
                     "phrase": phrase.dictionary.take(pa.array(of_phrase)), "f": f})


def count_phrases(dictionary: DataFrame, width: int, longest: int, wanted: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f), exact, of the phrases of ``width`` words whose keys are in the bitmap ``wanted`` (all if None)."""
    shared = None if wanted is None else dictionary.sparkSession.sparkContext.broadcast(wanted)
    at_once, combine = CHUNKS_AT_ONCE, COMBINE_PHRASES
    counted = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[pa.Table]) -> pa.Table:
            table = parts[0] if len(parts) == 1 else pa.concat_tables(parts)
            lang, phrase, f = (pa.concat_arrays(c.chunks) for c in table.columns)
            return _phrases_once(lang, phrase, f.to_numpy())

        gathered: list[pa.Table] = []
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                lang, chunk, last, times, hashes = (c.slice(i, at_once) for c in batch.columns)
                places = _Places(lang, last.to_numpy(zero_copy_only=False), hashes, width, longest)
                if shared is not None and len(places.at):
                    places.keep(shared.value, places.keys(width))
                if not len(places.at):
                    continue
                words, owner = _words_of(chunk).flatten(), places.chunk
                if width == 1:
                    gathered.append(_phrases_once(lang, words, times.to_numpy()[owner], owner, places.at))
                else:
                    parts = [words.take(pa.array(places.at + k)) for k in range(width)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                    owner = pa.array(owner)
                    gathered.append(pa.table({"lang": lang.take(owner), "phrase": phrase, "f": times.take(owner)}))
                if sum(t.num_rows for t in gathered) >= combine:
                    gathered = [merged(gathered)]
                    if gathered[0].num_rows >= combine // 2:
                        yield from gathered[0].cast(counted).to_batches()
                        gathered = []
        if gathered:
            yield from merged(gathered).cast(counted).to_batches()

    return (_long_enough(dictionary, width).select("lang", "chunk", "last", "places", "hashes")
            .mapInArrow(released(run), "lang string, phrase string, f long")
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")))


def _phrase_keys(frequent: DataFrame, width: int) -> DataFrame:
    """(key) of phrases (lang, phrase) of ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _Places(batch.column(0), np.ones(batch.num_rows, bool), _hashes_of(batch.column(1)), width, width)
            yield pa.RecordBatch.from_arrays([pa.array(places.keys(width).view("i8"))], ["key"])

    return frequent.select("lang", "phrase").mapInArrow(run, "key long")


def frequent_phrases(dictionary: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words with f >= least."""
    out, wanted = None, None
    for width in range(1, longest + 1):
        if out is not None:
            passed = bitmap_of(_phrase_keys(level, width - 1), F.col("key"))
            wanted = bitmap_of(may_be_frequent(dictionary, width, longest, passed, least), F.col("key"))
        level = materialize(count_phrases(dictionary, width, longest, wanted).filter(F.col("f") >= least),
                            f"phrases-{width}")
        sized = level.select("lang", "phrase", F.lit(width).alias("words"), "f")
        out = sized if out is None else out.unionByName(sized)
    return out


def lowest_cuts(cuts: DataFrame) -> DataFrame:
    """Of each candidate's cuts (lang, phrase, words, a, n, k, l, r) the one with the lowest
    floor(1000 a n / (l r)), ties to the smallest k; in exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, left, right = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("a", "n", "l", "r"))
            scores = [1000 * w * x // (y * z) for w, x, y, z in zip(a, n, left, right, strict=True)]
            yield batch.append_column("score", pa.array(scores, pa.int64()))

    scored = cuts.mapInArrow(run, f"{cuts._jdf.schema().toDDL()}, score long")
    return (scored.groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("lowest"))
            .select("lang", "phrase", "a", "n", "lowest.score", "lowest.l", "lowest.r"))


def mine_collocations(docs: DataFrame, longest: int = 5, least: int = 100, absorb_percent: int = 100,
                      top: int = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Needs ``text`` and ``lang``; other columns are ignored. Texts are cut into pieces at
    ``.,;:!?`` and line ends and those into words at spaces and tabs, A-Z
    lower-cased; a NULL text has no words, a NULL lang is ``und``. Candidates are
    phrases of 2 to ``longest`` words that occur ``least`` times or more within
    pieces (a; overlaps included). A cut after k words gives l and r, the counts of
    both parts, and floor(1000 a n / (l r)) with n, the language's word occurrences; the
    lowest of these is the score. Candidates inside a longer one with 100 * its count >=
    absorb_percent * a are left out. Order: score and a descending, phrase by its
    bytes. Repeated rows count as often as they occur; an empty table gives an empty result.
    """
    dictionary = materialize(with_hashes(chunk_dictionary(docs, longest)), "chunks")
    frequent = materialize(frequent_phrases(dictionary, longest, least), "frequent-phrases")
    candidates = frequent.filter(F.col("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    split, count = F.split("phrase", " "), F.col("words")

    def joined(array, start, size):
        return F.array_join(F.slice(array, start, size), " ")

    inside = candidates.filter(count > 2).select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), count - 1), lambda size: F.transform(
            F.sequence(F.lit(1), count - size + 1), lambda start: joined(split, start, size))))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = (candidates.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("a"))).drop("longer"))
    cuts = stay.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), count - 1)).alias("k"), split.alias("s"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.col("s"), F.lit(1), F.col("k")).alias("head"),
                       joined(F.col("s"), F.col("k") + 1, count - F.col("k")).alias("tail"))
    parts = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    ends = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    totals = materialize(word_totals(dictionary, longest), "word-totals").withColumnRenamed("total", "n")
    cuts = (cuts.join(parts, ["lang", "head"]).join(ends, ["lang", "tail"]).join(totals, "lang")
            .select("lang", "phrase", "a", "n", "k", "l", "r"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (lowest_cuts(cuts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
