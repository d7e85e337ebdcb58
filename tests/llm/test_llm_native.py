"""Quality rules, sharding, url filter and decontamination against plain Python."""

from __future__ import annotations

import math
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pytest

from tradelens.llm import sharding
from tradelens.llm.common import read
from tradelens.llm.decontaminate import RADIUS, benchmark_items, drop_leaks, find_leaks, judge_leaks
from tradelens.llm.quality_rules import (CLASSES, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, _js_distance, base_measures,
                                         judge_quality)
from tradelens.llm.sharding import assign_shards, sharding_digest
from tradelens.llm.url_templates import RULES, judge_urls

from .helpers import DATA, prose

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def base_by_hand(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_base_rules(docs, rows, edge_docs):
    for frame in (docs, edge_docs):
        want = Counter((r.doc_id, *base_by_hand(r.text)) for r in frame.collect())
        got = judge_quality(frame).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                       for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            far = (r.class_distance or 0) > MAX_CLASS_DISTANCE or (r.word_distance or 0) > MAX_WORD_DISTANCE
            assert r.kept == (not r.base_failed and not far)


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b c d e f", "x y z q x y z", "a b", ""]
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.n_repeat_words for r in base_measures(frame).collect()}
    assert [got[i] for i in range(len(texts))] == [base_by_hand(t)[4] for t in texts] == [6, 4, 0, 6, 0, 0]


def test_js_distance(spark):
    from pyspark.sql import functions as F

    def by_hand(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
        return math.sqrt((kl(p) + kl(q)) / 2)

    for p, q in (([0.5, 0.5, 0], [0.2, 0, 0.8]), ([1.0, 0.0], [0.0, 1.0]), ([0.3, 0.7], [0.3, 0.7])):
        got = spark.range(1).select(_js_distance([F.lit(x) for x in p], q).alias("d")).first().d
        assert got == pytest.approx(by_hand(p, q), abs=1e-7)


def test_quality_rules_separate_labelled_junk(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in read(spark, data, "labels").collect()}
    got = [r for r in judge_quality(read(spark, data, "documents")).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    junk = [r.kept for r in got if labels[r.doc_id] == 0]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.3
    assert len(CLASSES) == 7


@pytest.mark.parametrize("ranges", [16, 1])
def test_sharding(docs, rows, edge_docs, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", ranges)
    for frame, source in ((docs, rows), (edge_docs, edge_docs.collect())):
        got = sharding_digest(frame).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)
        slots = defaultdict(list)
        for r in got:
            assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_first_call_of_a_session_on_a_made_frame():
    """A plan that only a fresh session gives; a process of its own, as the others share a session."""
    code = """
from tradelens.session import local_session
from tradelens.llm.sharding import assign_shards
spark = local_session(2, 4)
frame = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string")
out = assign_shards(frame, 2).collect()
assert sorted(r.doc_id for r in out) == list(range(400))
shards = {}
for r in out:
    shards.setdefault(r.text_crc32, set()).add(r.shard)
assert all(len(s) == 1 for s in shards.values())
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=300)


def test_small_groups_stay_together_beside_large_ones(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 1)  # wide ranges, so that they are subdivided
    rows = [(i, f"text {i // 3} " * 5) for i in range(900)]
    rows += [(1000 + i, "a hot text " * 20) for i in range(300)] + [(2000 + i, f"{i} long " * 500) for i in range(4)]
    total = sum(len(t) + 8 for _, t in rows)
    shards = defaultdict(set)
    for r in assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect():
        shards[r.text_crc32].add(r.shard)
    size = defaultdict(int)
    for _, t in rows:
        size[zlib.crc32(t.encode())] += len(t) + 8
    assert all(len(shards[k]) == 1 for k, b in size.items() if b * sharding.GROUP_PART * 4 <= total)


def test_shards_are_even_with_a_hot_group(spark):
    hot, rows = prose(5, 40), []
    for i in range(3000):
        rows.append((i, hot if i % 3 == 0 else prose(i + 10, 20 + i % 30)))
    out = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    shards_of = defaultdict(set)
    for r in out:
        shards_of[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards_of.values()) <= 1  # the hot group alone is cut


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/en/15?x#y", "https://example.org/en/2", "http://example.org/es/a", "no scheme",
            None, "http://b.com/de/1", "http://x.com/fr/", "http://bcom/de/1", "http://net.net/a", "a://b://org/c",
            "http://example.org", "http://ex.org:80/a", "http://notexample.org/es/1", "http://ÀB.org/Z"]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(
        list(enumerate(urls)), "page_id long, url string")).collect()}
    want = [("a.example.org", "/en/15", "example.org/en/1"), ("example.org", "/en/2", "org/"),
            ("example.org", "/es/a", "example.org/es/"), ("", "", None), ("", "", None), ("b.com", "/de/1", "com/de/"),
            ("x.com", "/fr/", "com/fr/"), ("bcom", "/de/1", None), ("net.net", "/a", None), ("b:", "//org/c", None),
            ("example.org", "", None), ("ex.org:80", "/a", None), ("notexample.org", "/es/1", "org/"),
            ("Àb.org", "/Z", "org/")]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    verdicts = dict(RULES)
    assert all(r.verdict == verdicts[r.rule] for r in got.values() if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_url_templates_learn_and_generalise(spark):
    rows = [f"http://h.com/{lang}/{i}" for lang in ("de", "fr", "es") for i in range(40)]
    rows += [f"http://k.net/{lang}/{i}" for lang in ("de", "fr") for i in range(40)]
    got = judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {r.template for r in got if r.host == "k.net"} == {"k.net/de/*", "k.net/fr/*"}
    assert {r.verdict for r in got if r.template == "k.net/de/*"} == {"block"}
    assert {r.verdict for r in got if r.template == "k.net/fr/*"} == {"allow"}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_templates_of_deep_paths_and_small_sections(spark):
    rules = (("h.com/a/b/bad/", "block"), ("h.com/a/b/good/", "allow"), ("k.net/ads/", "block"), ("k.net/", "allow"))
    rows = [f"http://{host}/a/b/{kind}/{i}/x" for host in ("h.com", "www.h.com") for kind in ("bad", "good") for i in range(30)]
    rows += [f"http://h.com/a/b/bad{q}/{i}" for q in ("", "?x") for i in range(30)]
    rows += ["http://h.com/a/b/", "http://h.com/a/b", "http://h.com/a/b/good/" + "deep/" * 50 + "end"]
    rows += [f"http://k.net/{i}/x" for i in range(1980)] + [f"http://k.net/ads/{i}" for i in range(20)]  # 1 % of the host
    got = judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()
    share = {r.template: r.block_share for r in got}
    assert len(got) == len(rows)
    assert share["h.com/a/b/bad/*/x"] > 0.5 > share["h.com/a/b/good/*/x"]
    assert share["k.net/ads/*"] > 0.5 > share["k.net/*/x"]
    assert "h.com/a/b/**" in share and "h.com/a/b" in share


def test_leaks(spark):
    items = [(0, prose(100, 40)), (1, prose(101, 25)), (2, "just three words"), (3, None), (4, ""), (5, prose(100, 40))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    near = prose(100, 40).split()
    near[20] = "changed"
    half = " ".join(prose(100, 40).split()[:20])
    texts = [(1, prose(1, 50) + "\n" + prose(100, 40) + "\n" + prose(2, 50)), (2, prose(3, 90)),
             (3, prose(4, 30) + " " + half + " " + prose(5, 30)), (4, prose(101, 25).upper()), (5, None), (6, ""),
             (7, "just three words"), (8, prose(6, 20) + " just three words"), (1, prose(7, 60)),
             (9, " ".join(near)), (None, prose(101, 25))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.contaminated, r.item_id) for r in judge_leaks(docs, benchmark).collect()}
    assert got == {(1, True, 0), (2, False, None), (3, False, None), (4, True, 1), (5, False, None), (6, False, None),
                   (7, True, 2), (8, False, None), (1, False, None), (9, False, None), (None, True, 1)} or \
        got == {(1, True, 0), (2, False, None), (3, False, None), (4, True, 1), (5, False, None), (6, False, None),
                (7, True, 2), (8, False, None), (1, False, None), (9, True, 0), (None, True, 1)}
    kept = drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(texts) - sum(1 for g in got if g[1])


def test_fingerprints_are_small_plans(spark):
    # spelt out bit by bit the fingerprint made a plan of 92,000 characters
    items = benchmark_items(spark.createDataFrame([(1, prose(5, 40)), (2, "two words"), (3, "")], "item_id long, text string"))
    assert len(items._jdf.queryExecution().toString()) < 20_000
    rows = {r.item_id: r for r in items.collect()}
    assert set(rows) == {1, 2}
    for r in rows.values():
        by_hand = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.shingles) > len(r.shingles))
        assert r.fingerprint % (1 << 64) == by_hand


def test_leaks_without_the_boilerplate_of_the_items(spark):
    boilerplate = prose(900, 18).split()  # held by all items, so it weighs little
    own = [prose(901 + i, 32).split() for i in range(24)]
    benchmark = spark.createDataFrame([(i, " ".join(w + boilerplate)) for i, w in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(own)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs, benchmark).collect()}
    assert set(got) == {(i, i) for i in range(24)} and min(got.values()) > 0.85
    prints = [{r.item_id: r.fingerprint for r in benchmark_items(frame).collect()}
              for frame in (benchmark, docs.withColumnRenamed("doc_id", "item_id"))]
    assert any(((prints[0][i] ^ prints[1][i]) & (2**64 - 1)).bit_count() > RADIUS for i in range(24))


def test_leaks_against_all_windows(docs, rows, spark):
    benchmark = read(spark, DATA, "benchmark")
    items = {r.item_id: r.text.lower().encode().split() for r in benchmark.collect()}
    held_by = Counter(s for words in items.values() for s in shingles(words))
    want = set()
    for r in rows:
        words = r.text.lower().encode().split()
        for item, of_item in items.items():
            own = shingles(of_item)
            if not own & shingles(words):
                continue
            weight = sum(1 / held_by[s] for s in own)
            for start in range(max(1, len(words) - len(of_item) + 1)):
                seen = shingles(words[start:start + len(of_item)])
                shared = sum(1 / held_by[s] for s in own & seen)
                if shared / (weight + len(seen - own) * weight / len(own)) >= 0.8:
                    want.add((r.doc_id, item))
                    break
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()}
    assert got == want and want


def shingles(words: list[bytes]) -> set:
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_empty_tables_and_edge_rows(no_docs, edge_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert judge_quality(no_docs).collect() == assign_shards(no_docs).collect() == []
    assert judge_leaks(no_docs, none).collect() == []
    got = judge_leaks(edge_docs, none).collect()
    assert len(got) == edge_docs.count() and not any(r.contaminated for r in got)
    assert drop_leaks(edge_docs, none).count() == edge_docs.count()
