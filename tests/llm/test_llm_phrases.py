"""Token alignment, MinHash near-dedup and collocations against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import re
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tradelens.llm import collocations, minhash_dedup, token_alignment
from tradelens.llm.collocations import chunk_dictionary, mine_collocations, parse, pieces_of
from tradelens.llm.minhash_dedup import BINS, band_keys, describe, join_bucket, near_duplicates, signature
from tradelens.llm.pretokens import byte_characters
from tradelens.llm.shingles import Shingler
from tradelens.llm.token_alignment import align_tokens, alignment_digest, load_pair

from .helpers import prose
from .test_llm_documents import components_by_hand, near_copies, shingle_set

# ------------------------------------------------------------------ alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_BYTE = {c: b for b, c in byte_characters().items()}


def tokens_by_hand(text):
    """([(id, bytes)], [(id, bytes)]) by the libraries themselves."""
    if not text:
        return [], []
    a = [(i, bytes(_BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) and B.is_byte(i)
                  else piece.replace("▁", " ").encode()))
    spelled = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == spelled for side in (a, b)) else ([], [])


def groups_by_hand(text):
    a, b = tokens_by_hand(text)
    common = set(np.cumsum([len(x) for _, x in a]).tolist()) & set(np.cumsum([len(x) for _, x in b]).tolist())
    sides = []
    for side in (a, b):
        groups, at = [[]], 0
        for i, spelled in side:
            groups[-1].append(i)
            at += len(spelled)
            if at in common:
                groups.append([])
        sides.append(groups[:-1])
    return list(zip(*sides, strict=True))


def digest_by_hand(rows):
    groups = [groups_by_hand(r.text) for r in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for k in links for p in k)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for r, g, k in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out[(r.doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(k.values()),
             sum(n for p, n in k.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in k.items()),
             hashlib.sha256(text.encode()).hexdigest() if text else "")] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'stvedlm.,!09aZéßñ²½€…  ▁"), st.characters(
    exclude_categories=["Cs", "Cn"])), max_size=40) | st.sampled_from(["<|endoftext|>", "a <s> <0x41> <unk>  b's"]))
def test_both_sides_encode_as_their_libraries(text):
    a, b = load_pair().encode(text)
    by_hand = tokens_by_hand(text)
    assert (a, b) == tuple([i for i, _ in side] for side in by_hand)


@pytest.mark.parametrize("hot, expanded", [(1 << 20, 1 << 21), (50, 7), (0, 1 << 21)])
def test_alignment_digest(docs, rows, monkeypatch, hot, expanded):
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", expanded)
    some = docs.filter("doc_id < 60")
    assert Counter(map(tuple, alignment_digest(some).collect())) == digest_by_hand([r for r in rows if r.doc_id < 60])


def test_alignment_edge_rows(edge_docs, no_docs):
    assert Counter(map(tuple, alignment_digest(edge_docs).collect())) == digest_by_hand(edge_docs.collect())
    assert alignment_digest(no_docs).collect() == []
    assert align_tokens(no_docs).collect() == []


def test_aligned_groups_and_overlaps(edge_docs):
    found = defaultdict(list)
    one_each = edge_docs.filter("doc_id in (2, 3, 5, 6, 8, 9)")
    for r in align_tokens(one_each).collect():
        found[r.doc_id].append(r)
    pair = load_pair()
    for r in one_each.collect():
        groups = sorted(found[r.doc_id], key=lambda g: g.number)
        assert [(g.a_ids, g.b_ids) for g in groups] == groups_by_hand(r.text)
        at = 0
        for number, g in enumerate(groups):
            assert (g.number, g.start) == (number, at)
            at = g.end
            spans = []
            for ids, spelled in ((g.a_ids, pair.bytes_a), (g.b_ids, pair.bytes_b)):
                ends = np.cumsum([len(spelled[i]) for i in ids])
                spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
            want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e}
            assert {(o.a, o.b) for o in g.overlaps} == want and len(g.overlaps) == len(want)
        assert not groups or at == len((" " + r.text).encode())


# ------------------------------------------------------------------ near duplicates

def test_signatures_of_small_and_large_sets():
    rng = np.random.default_rng(1)
    agree = []
    for n in (1, 3, 20, 79, 80, 500):
        for _ in range(200):
            own = np.unique(rng.integers(0, 1 << 64, n, "u8", endpoint=False))
            minima = signature(own)
            assert len(minima) == BINS and np.isin(minima, own).all() and len(band_keys(minima)) == 20
            if n >= 20:
                other = np.unique(np.append(own[:-n // 10], rng.integers(0, 1 << 64, n // 10, "u8")))
                j = len(np.intersect1d(own, other)) / len(np.union1d(own, other))
                agree.append((signature(other) == minima).mean() - j)
    assert abs(np.mean(agree)) < 0.02  # the share of equal bins estimates the similarity


@pytest.fixture(scope="module")
def near(spark):
    texts = near_copies(1, 40, 150, 9) + near_copies(2, 25, 60, 4) + near_copies(3, 60, 40, 3)
    texts += [prose(50 + i, 30 + i) for i in range(25)] + [texts[0]] * 12 + ["", None, "two words", "TWO words", "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("width, percent, bucket", [(3, 85, 512), (5, 80, 512), (3, 85, 6)])
def test_near_duplicates(near, monkeypatch, width, percent, bucket):
    monkeypatch.setattr(minhash_dedup, "BUCKET_DOCS", bucket)  # 6: buckets are cut into pairs of blocks
    want = components_by_hand(near.collect(), width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(near, width, percent).collect()}
    assert got == want


def test_near_duplicates_edge_rows(edge_docs, no_docs, spark):
    got = near_duplicates(edge_docs, 3, 85).collect()
    want = components_by_hand(edge_docs.collect(), 3, 85)
    assert len(got) == edge_docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(no_docs).collect() == []
    # rows of one doc_id with different texts are documents of their own
    one, two = prose(7, 50), prose(8, 50)
    twice = spark.createDataFrame([(5, one), (5, two), (9, two), (3, one)], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in near_duplicates(twice).collect()) == Counter(
        [(5, 3), (3, 3), (5, 5), (9, 5)])


def test_bucket_join_links_components():
    texts = near_copies(5, 30, 50, 6) + near_copies(6, 10, 50, 6)
    sets, shingle = [shingle_set(t, 3) for t in texts], Shingler(3)
    root = list(range(len(texts)))
    for u, v in join_bucket(np.arange(len(texts)), np.arange(len(texts)), [shingle(t) for t in texts], 85):
        assert 100 * len(sets[u] & sets[v]) >= 85 * len(sets[u] | sets[v])
        root = [root[u] if x == root[v] else x for x in root]
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                assert root[i] == root[j]


def test_every_row_is_described_once(near):
    assert describe(near, 3).select("row").distinct().count() == near.count()


# ------------------------------------------------------------------ collocations

def collocations_by_hand(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r.lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in held.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and counts[p[i:j]] <= a}
        scored = []
        for p, a in held.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s)
                for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("least, top, period, at_once, combine", [(5, 40, 24, 50_000, 1 << 20), (3, 2000, 2, 700, 5000)])
def test_collocations(docs, rows, monkeypatch, least, top, period, at_once, combine):
    monkeypatch.setattr(collocations, "PERIOD", period)
    monkeypatch.setattr(collocations, "CHUNKS_AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "COMBINE_PHRASES", combine)
    monkeypatch.setattr(collocations, "COMBINE_NUMBERS", combine)
    got = mine_collocations(docs, least=least, top=top).collect()
    assert Counter(map(tuple, got)) == Counter(collocations_by_hand(rows, 5, least, top)) and len(got) > 40


def test_collocations_of_edge_rows(edge_docs, no_docs, spark):
    assert Counter(map(tuple, mine_collocations(edge_docs, least=2).collect())) == Counter(
        collocations_by_hand(edge_docs.collect(), 5, 2, 2000))
    assert mine_collocations(no_docs).collect() == []
    repeated = [("a b a b a b a b a b", "x"), ("A B\tC, c d! c d; c d: c d", None), ("a b c d e f\na b c d e f", "x"),
                ("É é É é", "x"), (None, "x"), ("", None), ("a b c d e f.", "y"), ("a b c d e f.", "y")]
    small = spark.createDataFrame(repeated, "text string, lang string")
    assert Counter(map(tuple, mine_collocations(small, least=2).collect())) == Counter(
        collocations_by_hand(small.collect(), 5, 2, 2000))


def test_scores_beyond_64_bits(spark):
    big = 1 << 60
    cuts = spark.createDataFrame([("x", "a b", big, big * 4, 1, big * 2, big * 3), ("x", "a b", big, big * 4, 2, big, big)],
                                 "lang string, phrase string, a long, n long, k long, l long, r long")
    (row,) = collocations.lowest_cuts(cuts).collect()
    assert (row.score, row.l, row.r) == (1000 * big * big * 4 // (big * 2 * big * 3), big * 2, big * 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd", "."]), max_size=120), st.integers(1, 9))
def test_parse_counts_each_start_once(words, period):
    before, collocations.PERIOD = collocations.PERIOD, period
    try:
        pieces = pieces_of(" ".join(words))
        chunks = parse(pieces, 4)
    finally:
        collocations.PERIOD = before
    for k in range(1, 6):
        got, want = Counter(), Counter()
        for chunk, last in chunks:
            w = chunk.split(" ")
            starts = min(len(w) if last else len(w) - 4, len(w) - k + 1)
            got.update(tuple(w[i:i + k]) for i in range(starts))
        for p in pieces:
            want.update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
        assert got == want


def test_chunks_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(collocations, "PERIOD", 3)
    texts = ["", None, "A\tb  c d e f g h", "x.y!z\rÉt漢 B ", " .;\n", prose(1, 300), "b", "c d e f g h a\vb", "w" * 5000]
    chunks, last, text = collocations._chunks(texts, 4)
    want = [(i, *c) for i, t in enumerate(texts) for c in parse(pieces_of(t), 4)]
    assert list(zip(text.tolist(), chunks.to_pylist(), last.tolist(), strict=True)) == want and len(want) > 20
    for t in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        found = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]
        assert pieces_of(t) == [words for words in found if words]


def test_dictionary_has_each_chunk_once(docs):
    dictionary = chunk_dictionary(docs, 5)
    assert dictionary.count() == dictionary.select("lang", "chunk", "last").distinct().count()
