"""Pre-tokens of a byte-level BPE tokenizer file, and the ids of one pre-token.

Merges never cross a pre-token, so a text's ids are its pre-tokens' ids in
order. Texts of ASCII, Latin letters and common punctuation are split by one
compiled pattern; any other text is split by the library's own pre-tokenizer,
so that both always agree with it.
"""

from __future__ import annotations

import functools
import json
import os
import re

import public_tokenizers
from tokenizers import Tokenizer

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

_SPACE = r" \t-\r"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NOT_SIMPLE = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ɏ‐-‧‰-⁞€]")


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (GPT-2's public rule)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(kept))
    return table


class ByteLevelTokens:
    """Splits texts into pre-tokens and gives a pre-token's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = (spec["normalizer"] is None and pre.get("type") == "ByteLevel"
                 and not pre["add_prefix_space"] and pre["use_regex"]
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        if not plain:
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bytes = byte_characters()
        self._added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def _segment(self, text: str) -> list[str]:
        if not _NOT_SIMPLE.search(text):
            return _SIMPLE.findall(text)
        return [text[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of ``text``; a special string inside it is one of them."""
        if not any(s in text for s in self._added):
            return self._segment(text)
        out: list[str] = []
        for part in self._split_added.split(text):
            out.extend([part] if part in self._added else self._segment(part))
        return out

    def ids(self, piece: str) -> list[int]:
        """Token ids of one pre-token."""
        if piece in self._added:
            return [self._added[piece]]
        symbols = piece.encode("utf-8").decode("latin-1").translate(self._bytes)
        return [t.id for t in self._model.tokenize(symbols)]


def tokenizer_path(tokenizer: str) -> str:
    """A file path as it is; a bare name is looked up among the public tokenizers."""
    return tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer)


@functools.lru_cache(maxsize=4)
def load_tokens(tokenizer: str = DEFAULT_TOKENIZER) -> ByteLevelTokens:
    """One instance per Python worker."""
    return ByteLevelTokens(tokenizer_path(tokenizer))
