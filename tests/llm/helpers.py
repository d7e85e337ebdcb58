"""What the tests of this folder share besides fixtures."""

from __future__ import annotations

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ("h", "n", "gone", "score", "piece", "words", "digest", "tokens", "key", "size", "start", "length",
           "n_words", "common", "shingles", "part", "held_out")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[i:i + 12]) for i in range(0, len(out), 12))


def edge_rows() -> list[tuple]:
    one, very_long = prose(1, 120), prose(2, 30_000)
    texts = [(1, one), (1, one), (2, None), (3, ""), (4, " \n\t \n"), (5, very_long), (6, prose(3, 80)), (7, prose(3, 80)),
             (8, "word"), (None, prose(4, 90)), (9, "Été über <|endoftext|> 漢字 ½ \u00a0x"), (10, "a" * 50_000)]
    return [(i, t, "en" if k % 2 else None, "s", len(t or "")) for k, (i, t) in enumerate(texts)]
