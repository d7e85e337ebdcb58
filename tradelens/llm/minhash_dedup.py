"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1. A shingle's hash is its place in the one permutation; the range of hashes is cut
   into ``BINS`` bins and a bin keeps its least hash. An empty bin takes the
   value of the first non-empty one in an order of bins that a fixed random
   table gives it (optimal densification), so small sets have whole signatures too.
2. Equal sets are one node. A signature is cut into ``BANDS`` bands; nodes that
   agree in a band share a bucket. With 20 bands of 4 bins a pair of similarity
   0.85 misses all buckets with a chance of 4e-7.
3. Every bucket is a star: each member is a candidate with the bucket's least
   node only, so there are fewer candidates than bucket entries. Candidates are
   confirmed on their full shingle sets.
4. A star loses links between members that its centre isn't linked with. So
   buckets whose members are not one component yet are taken again: in one task
   each, member by member as the next centre of a star over the members of other
   components. A bucket beyond a task's bounds is cut into pairs of blocks, in which
   each member outside its largest component meets all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelens.llm.common import bitmap_of, materialize, released, slices, split_by_bitmap
from tradelens.llm.components import components
from tradelens.llm.shingles import Shingler, set_digest

#: Bands and bins in a band.
BANDS, ROWS = 20, 4
BINS = BANDS * ROWS
#: Parts into which a bucket's members are dealt where they meet its centre.
SALTS = 16
#: What one task joins at most: members of a bucket and characters of their texts.
BUCKET_DOCS, BUCKET_CHARACTERS = 512, 4_000_000

_EDGES = np.array([(b << 64) // BINS for b in range(BINS)], "u8")
_RANDOM = np.random.Generator(np.random.PCG64(20171))
#: Which bins an empty bin asks, one after the other.
_ASKED = _RANDOM.integers(0, BINS, (1024, BINS))
_MIX = _RANDOM.integers(1, 1 << 63, (BANDS, ROWS), "u8") | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted array of hashes."""
    first = np.searchsorted(hashes, _EDGES)
    filled = first < np.append(first[1:], len(hashes))
    out = hashes[np.minimum(first, len(hashes) - 1)]
    if not filled.all():
        empty, values = np.flatnonzero(~filled), out.copy()
        for asked in _ASKED:
            answer = filled[asked[empty]]
            out[empty[answer]] = values[asked[empty[answer]]]
            empty = empty[~answer]
            if not len(empty):
                break
        out[empty] = values[filled][0]  # asked in vain 1024 times
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the bands have multipliers of their own."""
    keys = (minima.reshape(BANDS, ROWS) * _MIX).sum(1, dtype="u8")
    keys ^= keys >> np.uint64(31)
    return (keys * _MIX[:, 0]).view("i8")


def _key() -> tuple[Column, Column]:
    """What a text is found again by: doc_id and the text's hash."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per document row (a key), doc_id, h (hash of the text), digest of its set, n (its size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, row = Shingler(width), TaskContext.get().partitionId() << 40
        for part, held in slices(batches):
            sets = [shingle(text) for text in held]
            m = len(sets)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + m)), part.column(0), part.column(1), pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], ["row", "doc_id", "h", "digest", "n", "bands"])
            row += m

    return docs.select(*_key(), "text").mapInArrow(
        released(run), "row long, doc_id long, h long, digest binary, n long, bands array<long>")


def _texts_of(docs: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, text) of the nodes: only their documents' texts are moved."""
    wanted = materialize(reps.join(nodes, reps["row"] == nodes["node"]).select("node", "doc_id", "h"), "wanted-texts")
    known, key = docs.filter(F.col("doc_id").isNotNull()).select(*_key(), "text"), F.xxhash64("doc_id", "h")
    hit = split_by_bitmap(known, key, bitmap_of(wanted, key))[0]
    return hit.join(wanted, ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"])  # rows repeat


def confirm(candidates: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) of the candidates (centre, node) whose sets are similar enough."""
    with_text = candidates.join(texts.select("node", F.col("text").alias("v_text")), "node")
    both = with_text.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("u_text")), "centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, own = Shingler(width), None, np.empty(0, "u8")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                us, vs, kept = [], [], []
                part = batch.slice(at, 64)
                for u, v, u_text, v_text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if u != last:
                        last, own = u, shingle(u_text)
                    other = shingle(v_text)
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    us.append(u)
                    vs.append(v)
                    kept.append(100 * shared >= percent * (len(own) + len(other) - shared))
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())],
                                                 ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return both.select("centre", "node", "u_text", "v_text").mapInArrow(released(run), "u long, v long")


def join_bucket(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that make one component of what is linked in a bucket: each member in turn is the centre
    of a star over the members of other components."""
    n = np.fromiter(map(len, sets), "i8", len(sets))
    starts = np.cumsum(n) - n
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    label, links = np.unique(labels, return_inverse=True)[1], []
    for x in range(len(sets)):
        able = (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        able[:x] = False  # they were centres themselves
        if not able.any():
            continue
        own = np.zeros(len(shingle), "i8")
        own[shingle[starts[x]:starts[x] + n[x]]] = 1
        shared = np.add.reduceat(own[shingle], starts)
        for y in np.flatnonzero(able & (100 * shared >= percent * (n + n[x] - shared))):
            if label[y] != label[x]:
                links.append((int(nodes[x]), int(nodes[y])))
                label[label == label[y]] = label[x]
    return links


def _open_buckets(buckets: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, node, label, text) of the buckets whose members are several components, each set of
    members once; those beyond a task's bounds as pairs of blocks."""
    roots = components(links).select(F.col("u").alias("node"), "root")
    sized = texts.select("node", F.length("text").alias("weight"))
    members = materialize(
        buckets.filter((F.col("m") > 2) & (F.col("node") != F.col("centre"))).select("key", "node")
        .join(roots, "node", "left").join(sized, "node")
        .select("key", "node", F.coalesce("root", "node").alias("label"), "weight"), "members")
    state = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("weight").alias("w"), F.min("label").alias("a"), F.max("label").alias("b"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = materialize(state.filter(F.col("a") != F.col("b")).groupBy("m", "w", "x", "y").agg(F.min("key").alias("key"))
                       .select("key", F.ceil(F.greatest(F.col("m") * 2 / BUCKET_DOCS, F.col("w") * 2 / BUCKET_CHARACTERS))
                               .alias("blocks")), "open-buckets")
    still = members.join(once, "key")
    small = still.filter(F.col("blocks") <= 2).select(F.col("key").cast("string").alias("bucket"), "node", "label")
    large = still.filter(F.col("blocks") > 2)
    by_label = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
    largest = by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("c"),
                                          F.sum("w").alias("w"))
    outside = F.ceil(F.greatest((F.col("c") - F.col("most.c")) * 2 / BUCKET_DOCS, F.col("w") * 2 / BUCKET_CHARACTERS))
    placed = (large.join(largest.select("key", F.col("most.label").alias("largest"), outside.alias("outer")), "key")
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
              .withColumn("as_outer", F.when(F.col("label") != F.col("largest"), F.pmod(F.xxhash64("node"), "outer"))))

    def pair(outer, block):
        return F.concat_ws("/", "key", outer, block)

    pairs = F.array_union(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1), lambda o: pair(o, F.col("block"))),
        F.when(F.col("as_outer").isNotNull(), F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: pair(F.col("as_outer"), b)))
        .otherwise(F.array().cast("array<string>")))
    both = small.unionByName(placed.select(F.explode(pairs).alias("bucket"), "node", "label"))
    return both.join(texts.select("node", "text"), "node")


def link_nodes(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) of nodes (rows of ``reps``) whose components are those of all candidates."""
    entries = reps.filter(F.col("doc_id").isNotNull()).select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    centres = entries.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    buckets = materialize(
        entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        .join(centres.withColumn("salt", every_salt), ["key", "salt"]).select("key", "node", "centre", "m"), "buckets")
    texts = materialize(_texts_of(docs, buckets.select("node").distinct(), reps), "bucket-texts")
    stars = buckets.filter(F.col("node") != F.col("centre")).select("centre", "node").distinct()
    links = materialize(confirm(stars, texts, width, percent), "star-links")

    def run(table: pa.Table) -> pa.Table:
        shingle = Shingler(width)
        table = table.sort_by("node")
        found = join_bucket(table.column("node").to_numpy(), table.column("label").to_numpy(),
                            [shingle(t) for t in table.column("text").to_pylist()], percent)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    more = (_open_buckets(buckets, links, texts).groupBy("bucket").applyInArrow(run, "u long, v long"))
    return links.unionByName(materialize(more, "bucket-links"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Needs ``doc_id`` and ``text``; other columns are ignored. Documents are linked
    when 100 * intersection >= percent * union of their sets of ``width``-word shingles
    (A-Z lower-cased; fewer words are one shingle), confirmed on the full sets;
    component_id is the smallest doc_id reachable by links. A NULL text or one
    without words is linked with nothing. Rows that share a doc_id and differ in their
    texts are documents of their own. A row without doc_id is linked with nothing, has
    no component_id and is kept. Repeated rows come out as often as they occur; an
    empty table gives an empty result.
    """
    described = materialize(describe(docs, width), "signatures")
    named = described.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # the first row of each set; tasks drop the others before the shuffle
    first = Window.partitionBy("digest").orderBy("row")
    reps = materialize(named.withColumn("k", F.row_number().over(first)).filter(F.col("k") == 1).drop("k"), "sets")
    located = materialize(
        named.select("row", "doc_id", "digest").join(reps.select("digest", F.col("row").alias("node")), "digest")
        .select("row", "doc_id", "node"), "located")
    roots = components(link_nodes(docs, reps, width, percent)).select(F.col("u").alias("node"), "root")
    placed = materialize(located.join(roots, "node", "left").select(
        "row", "doc_id", F.coalesce("root", "node").alias("root")), "placed-documents")
    least = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    known = placed.join(least, "root").select("row", "component_id")
    found = F.coalesce("component_id", "doc_id")
    return described.select("row", "doc_id", "n").join(known, "row", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
