"""Language ID: segmentation-marginalised unigrams.

The vocabulary is fixed and public (the pieces of a tokenizer file that are
lower-case letters, with or without a leading space). Each language has a
probability per piece. A word's probability is the sum over all its
segmentations into pieces, by a forward algorithm; a text's is the product
over its words, and the languages' posterior (equal priors) decides.

The piece probabilities come from expectation-maximisation over the word
counts of all training documents: words are counted in Spark, each round sums
the expected piece counts of every distinct (language, word) in Spark, and only
one number per language and piece reaches the driver.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tradelens.llm.common import held_out, materialize, text_or_empty
from tradelens.llm.pretokens import _LETTER, _NOT_SIMPLE, DEFAULT_TOKENIZER, byte_characters, tokenizer_path

#: Rounds of expectation-maximisation; pseudo-count; probability of an unknown letter.
ROUNDS, PSEUDO_COUNT, UNKNOWN = 3, 0.1, 1e-8
#: Letters up to which a word's sums are taken without logarithms: UNKNOWN ** 34 is far above the least double.
SHORT_WORD = 32
#: Words whose scores a task remembers before it starts anew; distinct words it gathers before it passes them on.
REMEMBERED, COMBINE_WORDS = 300_000, 300_000

_SIMPLE_WORD = re.compile(f"[{_LETTER}]+")
_ANY_WORD = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return (_ANY_WORD if _NOT_SIMPLE.search(text) else _SIMPLE_WORD).findall(text.lower())


def read_vocabulary(tokenizer: str = DEFAULT_TOKENIZER) -> list[str]:
    """The pieces: lower-case letters, with or without a leading space."""
    with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    byte_of, pieces = {c: b for b, c in byte_characters().items()}, set()
    for name in names:
        try:
            piece = bytes(byte_of[c] for c in name).decode("utf-8")
        except (KeyError, UnicodeDecodeError):  # special strings; parts of a character
            continue
        letters = piece.removeprefix(" ")
        if letters.isalpha() and piece == piece.lower():
            pieces.add(piece)
    return sorted(pieces)


class Segmenter:
    """Forward and backward sums over all segmentations of many words at once."""

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary), default=1)
        hashes = np.array([self._hashes(self._codes([p]))[len(p) - 1][0, 0] for p in vocabulary], "u8")
        order = np.argsort(hashes)
        self._hash, self._id = hashes[order], order
        self._maybe = np.zeros(1 << 20, bool)  # by the upper bits: most substrings are no piece
        self._maybe[self._hash >> np.uint64(44)] = True
        self.unknown = len(vocabulary)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype("u8")

    def _hashes(self, codes: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, .. up to the longest piece: a hash of the k characters from each place on."""
        out, h = [], np.zeros_like(codes)
        for k in range(min(self.longest, codes.shape[1])):
            h = (h[:, :codes.shape[1] - k] + codes[:, k:] + np.uint64(1)) * _BASE
            h ^= h >> np.uint64(31)
            out.append(h)
        return out

    def pieces(self, words: list[str]) -> list[np.ndarray]:
        """For k = 1, 2, ..: the piece of k characters from each place on; -1 if there is none."""
        out = []
        for k, h in enumerate(self._hashes(self._codes(words))):
            ids = np.full(h.shape, -1)
            maybe = self._maybe[h >> np.uint64(44)]
            wanted = h[maybe]
            at = np.minimum(np.searchsorted(self._hash, wanted), len(self._hash) - 1)
            ids[maybe] = np.where(self._hash[at] == wanted, self._id[at], -1)
            out.append(np.where(ids < 0, self.unknown, ids) if k == 0 else ids)
        return out

    @staticmethod
    def _somewhere(pieces: list[np.ndarray]) -> list[np.ndarray]:
        """For each length, the places where any of the words has a piece."""
        return [(ids >= 0).any(0) for ids in pieces]

    @staticmethod
    def forward(pieces: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """Sums (words, places, languages) over segmentations up to each place; p has a last row of 0."""
        n, length = pieces[0].shape
        alpha, found = np.zeros((n, length + 1, p.shape[1])), Segmenter._somewhere(pieces)
        alpha[:, 0] = 1
        for end in range(1, length + 1):
            for k in range(1, min(end, len(pieces)) + 1):
                if not found[k - 1][end - k]:
                    continue
                alpha[:, end] += alpha[:, end - k] * p[pieces[k - 1][:, end - k]]
        return alpha

    @staticmethod
    def backward(pieces: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        n, length = pieces[0].shape
        beta, found = np.zeros((n, length + 1, p.shape[1])), Segmenter._somewhere(pieces)
        beta[:, length] = 1
        for start in range(length - 1, -1, -1):
            for k in range(1, min(length - start, len(pieces)) + 1):
                if not found[k - 1][start]:
                    continue
                beta[:, start] += beta[:, start + k] * p[pieces[k - 1][:, start]]
        return beta

    @staticmethod
    def log_forward(pieces: list[np.ndarray], log_p: np.ndarray) -> np.ndarray:
        """The same in logarithms, for words so long that the sums would underflow."""
        n, length = pieces[0].shape
        alpha, found = np.full((n, length + 1, log_p.shape[1]), -np.inf), Segmenter._somewhere(pieces)
        alpha[:, 0] = 0
        for end in range(1, length + 1):
            for k in range(1, min(end, len(pieces)) + 1):
                if not found[k - 1][end - k]:
                    continue
                alpha[:, end] = np.logaddexp(alpha[:, end], alpha[:, end - k] + log_p[pieces[k - 1][:, end - k]])
        return alpha

    @staticmethod
    def log_backward(pieces: list[np.ndarray], log_p: np.ndarray) -> np.ndarray:
        n, length = pieces[0].shape
        beta, found = np.full((n, length + 1, log_p.shape[1]), -np.inf), Segmenter._somewhere(pieces)
        beta[:, length] = 0
        for start in range(length - 1, -1, -1):
            for k in range(1, min(length - start, len(pieces)) + 1):
                if not found[k - 1][start]:
                    continue
                beta[:, start] = np.logaddexp(beta[:, start], beta[:, start + k] + log_p[pieces[k - 1][:, start]])
        return beta

    def score(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """(words, languages): log probability of each word."""
        out, by_length, p = np.empty((len(words), log_p.shape[1])), defaultdict(list), np.exp(log_p)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, rows in by_length.items():
            step = max(1, 2_000_000 // ((length + 1) * log_p.shape[1]))  # bounded memory
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                pieces = self.pieces([" " + words[i] for i in part])
                out[part] = (np.log(self.forward(pieces, p)[:, -1]) if length <= SHORT_WORD
                             else self.log_forward(pieces, log_p)[:, -1])
        return out

    def expected(self, words: list[str], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected number of each piece (and of unknown letters) in words of one language."""
        total, by_length, p = np.zeros(self.unknown + 1), defaultdict(list), np.exp(log_p)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, rows in by_length.items():
            step = max(1, 500_000 // (length + 1))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                pieces = self.pieces([" " + words[i] for i in part])
                if length <= SHORT_WORD:
                    alpha, beta = self.forward(pieces, p)[..., 0], self.backward(pieces, p)[..., 0]
                    weight = counts[part][:, None] / alpha[:, -1:]
                else:
                    alpha, beta = self.log_forward(pieces, log_p)[..., 0], self.log_backward(pieces, log_p)[..., 0]
                    weight = np.log(counts[part])[:, None] - alpha[:, -1:]
                for k, ids in enumerate(pieces, 1):
                    share = (alpha[:, :ids.shape[1]] * p[ids, 0] * beta[:, k:] * weight if length <= SHORT_WORD
                             else np.exp(alpha[:, :ids.shape[1]] + log_p[ids, 0] + beta[:, k:] + weight))
                    known = ids >= 0
                    total += np.bincount(ids[known], share[known], len(total))
        return total


@functools.lru_cache(maxsize=2)
def load_segmenter(tokenizer: str) -> Segmenter:
    """One instance per Python worker."""
    return Segmenter(read_vocabulary(tokenizer))


def _log_table(p: np.ndarray) -> np.ndarray:
    """Rows: pieces, the unknown letter, and -inf for what is no piece (index -1)."""
    return np.vstack([np.log(p), np.full((1, p.shape[1]), np.log(UNKNOWN)), np.full((1, p.shape[1]), -np.inf)])


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all documents that may be learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()),
                     pa.array(words.values(), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(letter_words(text))
            if sum(map(len, seen.values())) >= COMBINE_WORDS:
                yield from out()
                seen.clear()
        yield from out()

    labelled = docs.filter(~held_out() & F.col("lang").isNotNull()).select("lang", text_or_empty().alias("text"))
    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def learn(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities of pieces by language)."""
    vocabulary = read_vocabulary(tokenizer)
    words = materialize(count_words(docs), "language-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    p = np.full((len(vocabulary), len(languages)), 1 / len(vocabulary))
    for _ in range(ROUNDS if languages else 0):
        log_p = docs.sparkSession.sparkContext.broadcast(_log_table(p))  # vocabulary x languages

        def expect(batches: Iterator[pa.RecordBatch], log_p=log_p) -> Iterator[pa.RecordBatch]:
            segmenter, total = load_segmenter(tokenizer), {}
            for batch in batches:
                langs = np.asarray(batch.column(0).to_pylist(), object)
                all_words, n = np.asarray(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
                for lang in set(langs.tolist()):
                    mine, g = langs == lang, languages.index(lang)
                    found = segmenter.expected(all_words[mine].tolist(), n[mine], log_p.value[:, g:g + 1])
                    total[lang] = total.get(lang, 0) + found
            for lang, found in total.items():
                pieces = np.flatnonzero(found[:-1] > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(pieces), pa.string()), pa.array(pieces), pa.array(found[pieces])],
                    ["lang", "piece", "n"])

        rows = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).toArrow()  # at most vocabulary x languages rows
        counts = np.full(p.shape, PSEUDO_COUNT)
        at = [languages.index(x) for x in rows.column("lang").to_pylist()]
        np.add.at(counts, (rows.column("piece").to_numpy(), at), rows.column("n").to_numpy())
        p = counts / counts.sum(0)
    return languages, p


def identify(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Needs ``doc_id``, ``text`` and ``lang`` (only to learn, from rows that
    aren't held out). score is the posterior of ``lang_pred``. A text that is
    NULL or has no letter is ``und`` with score 0, and so is every text if
    there is nothing to learn from. Ties go to the first language by name.
    Repeated rows come out as often as they occur; an empty table gives an
    empty result.
    """
    languages, p = learn(docs, tokenizer)
    log_p = docs.sparkSession.sparkContext.broadcast(_log_table(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, row_of, scores = load_segmenter(tokenizer), {}, np.empty((0, len(languages)))
        for batch in batches:
            found = [Counter(letter_words(t)) for t in batch.column(2).to_pylist()]
            if len(row_of) > REMEMBERED:
                row_of, scores = {}, scores[:0]
            new = [w for w in dict.fromkeys(w for words in found for w in words) if w not in row_of]
            row_of.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
            scores = np.vstack([scores, segmenter.score(new, log_p.value)]) if new else scores
            best, sure = [], []
            for words in found:
                if not words or not languages:
                    best.append("und")
                    sure.append(0.0)
                    continue
                at = np.fromiter(map(row_of.__getitem__, words), "i8", len(words))
                total = np.fromiter(words.values(), "f8", len(words)) @ scores[at]
                g = int(total.argmax())
                best.append(languages[g])
                sure.append(float(1 / np.exp(total - total[g]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(sure, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
