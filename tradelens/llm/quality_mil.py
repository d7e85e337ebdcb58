"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages with one label. Every passage is encoded (word
statistics and hashed words, then a small dense layer); gated attention (Ilse
et al., "Attention-based Deep Multiple Instance Learning", 2018) weighs the
passages, and a logistic unit scores the weighted representation:

    h = tanh(E x),  a = softmax(w . (tanh(V h) * sigmoid(U h))),  score = sigmoid(c . sum(a h) + d)

Only document labels are learnt from, on a bounded sample of labelled rows
(``SAMPLE_DOCS`` by hash of the id, each with all its passages, in that order as
far as ``SAMPLE_PASSAGES`` in all allow). Scoring uses every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tradelens.llm.common import held_out, materialize, released, text_or_empty

#: Words of a passage; hash buckets of its words; sizes of the encoding and of the attention.
PASSAGE_WORDS, BUCKETS, ENCODING, ATTENTION = 64, 256, 24, 16
#: The bounded sample: labelled documents, and passages of all of them together (about 1 KB each, so
#: 100 MB at most in the driver). A document is in it with all its passages or not at all.
SAMPLE_DOCS, SAMPLE_PASSAGES = 3000, 100_000
#: Passages that training encodes at once.
CHUNK_PASSAGES = 8192
EPOCHS, BATCH_DOCS, RATE, DECAY, SEED = 25, 64, 5e-3, 1e-4, 7
#: Words a task remembers before it starts anew; words it encodes at once.
REMEMBERED, CHUNK_WORDS = 200_000, 200_000

_WORD_STATS = 9  # per word; the passage adds its distinct, repeated and total words
_STATS = _WORD_STATS + 3


def _describe_word(word: str) -> tuple[float, ...]:
    letters = sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    return (min(len(word), 40) / 10, float(letters > 1 and upper == letters), float(word[:1].isupper()),
            sum(c.isdigit() for c in word) / len(word), 1 - sum(c.isalnum() for c in word) / len(word),
            float(letters == 0), float(not word[-1:].isalnum()), float(len(word) <= 3),
            float(not word.isascii()), xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS)


class PassageEncoder:
    """Texts to passage features; remembers words."""

    def __init__(self):
        self._row, self._table = {}, np.empty((0, _WORD_STATS + 1), "f4")

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self._row) > REMEMBERED:
            self._row, self._table = {}, self._table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self._row]
        if new:
            self._row.update(zip(new, range(len(self._row), len(self._row) + len(new)), strict=True))
            self._table = np.vstack([self._table, np.array([_describe_word(w) for w in new], "f4")])
        return np.fromiter(map(self._row.__getitem__, words), "i8", len(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features of all passages, number of passages of each text); a text without words has one of zeros."""
        split = [t.split() for t in texts]
        n_words = np.array([len(w) for w in split])
        n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
        rows = self._rows([w for words in split for w in words])
        first = np.cumsum(n_passages) - n_passages
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        passage = np.repeat(first, n_words) + inside // PASSAGE_WORDS
        total = int(n_passages.sum())
        size = np.bincount(passage, minlength=total).astype("f4")
        per_word = np.maximum(size, 1)[:, None]
        out = np.zeros((total, _STATS + BUCKETS), "f4")
        described = self._table[rows]
        for s in range(_WORD_STATS):
            out[:, s] = np.bincount(passage, described[:, s], total)
        distinct = np.unique(passage * (1 << 32) + rows) >> 32
        out[:, _WORD_STATS] = np.bincount(distinct, minlength=total)
        same = np.zeros(len(rows))
        same[1:] = (rows[1:] == rows[:-1]) & (passage[1:] == passage[:-1])
        out[:, _WORD_STATS + 1] = np.bincount(passage, same, total)
        out[:, :_STATS - 1] /= per_word
        out[:, _STATS - 1] = size / PASSAGE_WORDS
        counts = np.bincount(passage * BUCKETS + described[:, -1].astype("i8"), minlength=total * BUCKETS)
        out[:, _STATS:] = np.sqrt(counts.reshape(total, BUCKETS) / per_word)
        return out, n_passages

    def chunks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same in chunks of about CHUNK_WORDS words (by bytes), for bounded memory."""
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= 6 * CHUNK_WORDS:
                yield self(texts[start:i + 1])
                start, size = i + 1, 0
        if start < len(texts):
            yield self(texts[start:])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Weights by name, and the centre and spread of the features."""

    weights: dict[str, np.ndarray]
    centre: np.ndarray
    spread: np.ndarray
    constant: float | None = None  # a score for all texts, where there was nothing to tell apart

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        parts = [self._encode_chunk(x[a:a + CHUNK_PASSAGES]) for a in range(0, max(len(x), 1), CHUNK_PASSAGES)]
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _encode_chunk(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        h = np.tanh(((x - self.centre) / self.spread) @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        return h, t, g, (t * g) @ w["w"]

    def score(self, x: np.ndarray, n_passages: np.ndarray) -> np.ndarray:
        """One score per bag, for bags laid end to end."""
        if self.constant is not None:
            return np.full(len(n_passages), self.constant)
        h, _, _, a = self._encode(x)
        starts = np.cumsum(n_passages) - n_passages
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n_passages))
        a /= np.repeat(np.add.reduceat(a, starts), n_passages)
        z = np.add.reduceat(h * a[:, None], starts)
        return _sigmoid(z @ self.weights["c"] + self.weights["d"][0]).astype("f8")

    def gradient(self, x: np.ndarray, n_passages: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        w, starts = self.weights, np.cumsum(n_passages) - n_passages
        h, t, g, s = self._encode(x)
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n_passages))
        a /= np.repeat(np.add.reduceat(a, starts), n_passages)
        z = np.add.reduceat(h * a[:, None], starts)
        d_logit = (_sigmoid(z @ w["c"] + w["d"][0]) - y) / len(y)
        d_z = np.repeat(d_logit[:, None] * w["c"], n_passages, axis=0)
        d_a = (h * d_z).sum(1)
        d_s = a * (d_a - np.repeat(np.add.reduceat(a * d_a, starts), n_passages))
        d_t, d_g = d_s[:, None] * w["w"] * g * (1 - t * t), d_s[:, None] * w["w"] * t * g * (1 - g)
        d_h = (a[:, None] * d_z + d_t @ w["V"].T + d_g @ w["U"].T) * (1 - h * h)
        d_e = sum(((x[i:i + CHUNK_PASSAGES] - self.centre) / self.spread).T @ d_h[i:i + CHUNK_PASSAGES]
                  for i in range(0, len(x), CHUNK_PASSAGES))
        return {"E": d_e, "e": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_s,
                "c": z.T @ d_logit, "d": np.array([d_logit.sum()])}


def train(bags: list[np.ndarray], labels: np.ndarray) -> AttentionModel:
    """Adam on the mean logistic loss with weight decay."""
    if len(set(labels.tolist())) < 2:
        return AttentionModel({}, np.zeros(0), np.ones(0), float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(SEED)
    total = sum(map(len, bags))
    centre = sum(b.sum(0, dtype="f8") for b in bags) / total
    spread = np.sqrt(sum(((b - centre) ** 2).sum(0) for b in bags) / total).astype("f4")
    centre = centre.astype("f4")
    spread[:_STATS] = np.maximum(spread[:_STATS], 1e-3)
    spread[_STATS:] = max(float(spread[_STATS:].mean()), 1e-3) * 4  # hashed words share one, smaller scale
    n = len(centre)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    weights = {"E": start(n, ENCODING), "e": np.zeros(ENCODING), "V": start(ENCODING, ATTENTION),
               "U": start(ENCODING, ATTENTION), "w": start(ATTENTION), "c": start(ENCODING), "d": np.zeros(1)}
    model = AttentionModel(weights, centre, spread)
    m, v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH_DOCS):
            part, step = order[a:a + BATCH_DOCS], step + 1
            gradient = model.gradient(np.vstack([bags[i] for i in part]), np.array([len(bags[i]) for i in part]),
                                      labels[part])
            for k, g in gradient.items():
                g = g + DECAY * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """The model, from ``labels.quality`` of documents that aren't held out."""
    chosen = (labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))  # repeated labels: the best
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                x, (n,) = encoder([text])
                found.append((x.tobytes(), int(n)))
            bag, n = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bag, pa.binary()), pa.array(n, pa.int64()), batch.column(2)],
                ["doc_id", "bag", "n", "quality"])

    texts = (docs.select("doc_id", text_or_empty().alias("text"))
             .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int")))
    bagged = materialize(texts.mapInArrow(released(bags), "doc_id long, bag binary, n long, quality int"), "quality-bags")
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))
    within = (bagged.select("doc_id", "n").withColumn("so_far", so_far)  # SAMPLE_DOCS ids
              .groupBy("doc_id").agg(F.max("so_far").alias("so_far")).filter(F.col("so_far") <= SAMPLE_PASSAGES))
    rows = bagged.join(within.select("doc_id"), "doc_id").select("doc_id", "bag", "quality").toArrow().sort_by("doc_id")
    width = _STATS + BUCKETS
    return train([np.frombuffer(b, "f4").reshape(-1, width) for b in rows.column("bag").to_pylist()],
                 np.asarray(rows.column("quality").to_pylist(), "f8"))


def score_quality(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted (1 if score >= accept, else 0).

    Needs ``doc_id`` and ``text``, and ``doc_id`` and ``quality`` of the labels.
    Scores depend on the text alone. NULL and empty texts are one passage
    without words and get its score. With no labels every score is 0.5, with
    labels of one kind it is that label. Repeated rows come out as often as
    they occur; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    marked = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out())
    schema = marked.withColumn("score", F.lit(0.0)).schema
    at, names = marked.columns.index("text"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = [model.value.score(x, n) for x, n in encoder.chunks(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], names)

    return marked.mapInArrow(released(run), schema).withColumn("predicted", (F.col("score") >= accept).cast("int"))
