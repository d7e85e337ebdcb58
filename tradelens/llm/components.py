"""Connected components of an edge table, by large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Each
round is two joins with a pre-aggregated minimum, each written to the shared
folder; no component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradelens.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One operation on edges (u, v). large: every larger neighbour of u is tied to the
    least of u and its neighbours; small: so are u and its smaller neighbours."""
    def ends(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("u"), F.col(b).alias("v"))

    if large:
        around = edges.select(F.inline(F.array(ends("u", "v"), ends("v", "u"))))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = around.join(least, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.inline(F.array(ends("v", "m"), ends("u", "m"))))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) other than the least of its component."""
    now, before = materialize(edges.filter(F.col("u") != F.col("v")).distinct(), "edges"), None
    while True:
        tied = materialize(_star(now, large=True), "large-stars")  # one plan each: as one it holds its input many times
        now = materialize(_star(tied, large=False), "stars")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            return now.select("u", F.col("v").alias("root"))
        before = state
