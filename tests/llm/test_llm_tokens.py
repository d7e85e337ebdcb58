"""Token counts and packing against the tokenizer library itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tradelens.llm import token_counts
from tradelens.llm.packing import pack, packed_digest
from tradelens.llm.pretokens import load_tokens
from tradelens.llm.token_counts import count_tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'stvedlm.,!09aZéßñ²½€…\u00a0\u2003\x1c\x85"), st.characters(
    exclude_categories=["Cs", "Cn"])), max_size=40) | st.sampled_from(["<|endoftext|>", "a <|endoftext|>  b's"]))
def test_pieces_give_the_library_ids(text):
    tokens = load_tokens()
    assert [i for piece in tokens.split(text) for i in tokens.ids(piece)] == ids_of(text)


def test_counts_match_the_library(docs, rows):
    out = {r.doc_id: r for r in count_tokens(docs).collect()}
    assert len(out) == len(rows)
    for r in rows:
        want = len(ids_of(r.text))
        got = out[r.doc_id]
        assert (got.n_tokens, got.n_bytes, got.over_limit) == (want, len(r.text.encode()), want > 1024)


def test_hot_pieces_are_whole_steps_from_the_top(spark, monkeypatch):
    counts = [1] * 50 + [2] * 20 + [1000] * 5 + [10**12, 10**12]
    table = spark.createDataFrame([(f"p{i}", n, 1) for i, n in enumerate(counts)] + [("x" * 65, 10**13, 1)],
                                  "piece string, n long, tokens int")
    for most, want in ((1 << 19, 77), (77, 77), (76, 27), (27, 27), (26, 7), (6, 2), (1, 0)):
        monkeypatch.setattr(token_counts, "HOT_PIECES", most)
        assert token_counts.hot_pieces(table).count() == want


def test_counts_of_edge_rows_with_and_without_hot_pieces(edge_docs, monkeypatch):
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids_of(r.text))) for r in edge_docs.collect())
    for hot in (token_counts.HOT_PIECES, 3):
        monkeypatch.setattr(token_counts, "HOT_PIECES", hot)
        got = count_tokens(edge_docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def check_packing(source, pieces, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    wanted = Counter()
    for r in source:
        ids = ids_of(r.text) + [1]
        wanted[(r.doc_id, len(ids))] += len(ids)
    assert Counter({k: v for k, v in wanted.items()}) == Counter(
        {k: sum(p.length for p in pieces if (p.doc_id, p.doc_tokens) == k) for k in wanted})
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    full = sorted(by_sequence)
    assert full == list(range(len(full)))
    assert all(sum(p.length for p in by_sequence[s]) == length for s in full[:-1])


@pytest.mark.parametrize("length", [64, 2048])
def test_packing_round_trip(docs, rows, length):
    pieces = pack(docs, length).collect()
    check_packing(rows, pieces, length)
    ids = {r.doc_id: ids_of(r.text) + [1] for r in rows}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start:p.start + p.length]
        assert p.continued == (p.start > 0) and p.continues == (p.start + p.length < p.doc_tokens)
    digest = packed_digest(docs, length).limit(5).collect()
    for p in digest:
        part = np.asarray(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes()
        assert zlib.crc32(part) == p.ids_crc32


def test_packing_edge_rows(edge_docs):
    check_packing(edge_docs.collect(), pack(edge_docs, 128).collect(), 128)


def test_empty_tables(no_docs):
    assert count_tokens(no_docs).collect() == []
    assert pack(no_docs).collect() == []
