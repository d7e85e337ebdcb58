"""URL filter: a tree of path templates per host, judged by labelled purity.

A url rule (host and path prefix) decides where one fits; those pages are the
labels. For all other pages:

1. each host's paths form a tree by segment, to the end of the path. A segment
   seen rarely among its siblings (ids, slugs, dates) is variable and becomes
   the wildcard ``*``, unless its share of blocked labels differs from theirs;
2. sibling branches of one parent whose share of blocked labels does not
   differ statistically (two-proportion z test, neighbours in order of their
   share) are merged and judged together;
3. the share of blocked labels is smoothed from the root down: all hosts, the
   same first segment on all hosts, the host's merged branch, the template of
   two segments, then level by level (merged siblings, the branch itself) to
   the page's last segment. A level that separates no labels adds nothing. A
   template whose smoothed share reaches ``BLOCK_FROM`` is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelens.llm.common import materialize

#: (host and path prefix, verdict); a rule fits its host and all subdomains.
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)
#: A segment is kept literal from this many pages on, if it has this share of its parent's pages or its share of
#: blocked labels differs from its siblings'; else it is variable.
KEEP_PAGES, KEEP_SHARE = 5, 0.02
#: Pseudo-labels that each level takes from the level above; z below which branches are similar; share to block.
SMOOTHING, SIMILAR_Z, BLOCK_FROM = 8.0, 1.96, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    of_host = (F.col("host") == host) | F.col("host").endswith("." + host)
    return of_host & F.col("path").startswith(slash + path)


def _longest_fit(rules: Sequence[tuple[str, str]], give: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        out = F.when(_fits(rule[0]), F.lit(rule[give])).otherwise(out)
    return out


def _literal_or_wildcard(pages: DataFrame, parents: list[str], segment: str, name: str) -> DataFrame:
    """Adds ``name``: the segment where it is frequent below its parents or labelled unlike its siblings,
    ``*`` elsewhere ('' where there is none)."""
    children = pages.groupBy(*parents, segment).agg(
        F.count(F.lit(1)).alias("pages"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    of_parent = children.groupBy(*parents).agg(
        F.sum("pages").alias("of_parent"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    others_n, others_b = F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")
    p = F.try_divide("all_b", "all_n")
    apart = F.try_divide(F.col("b"), F.col("n")) - F.try_divide(others_b, others_n)
    z2 = F.try_divide(apart * apart, p * (1 - p) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), others_n)))
    frequent = F.col("pages") >= KEEP_SHARE * F.col("of_parent")
    kept = (children.join(of_parent, parents)
            .filter((F.col("pages") >= KEEP_PAGES) & (frequent | F.coalesce(z2 >= SIMILAR_Z**2, F.lit(False))))
            .select(*parents, segment, F.col(segment).alias(name)))
    joined = pages.join(kept, [*parents, segment], "left")
    return joined.withColumn(name, F.when(F.col(segment) == "", F.lit("")).otherwise(
        F.coalesce(F.col(name), F.lit("*"))))


def _smoothed(blocked: str, labelled: str, prior: str) -> Column:
    return (F.col(blocked) + SMOOTHING * F.col(prior)) / (F.col(labelled) + SMOOTHING)


def _merged_siblings(branches: DataFrame, parents: list[str], name: str) -> DataFrame:
    """(parents, name, group_bl, group_bb) of the branches (bl labels, bb of them blocked) that have labels.

    Siblings in order of their share; a new group starts where neighbours differ significantly.
    """
    siblings = Window.partitionBy(*parents).orderBy("share", name)  # literals and one wildcard
    pooled = (F.col("bb") + F.col("before_bb")) / (F.col("bl") + F.col("before_bl"))
    z = F.abs(F.col("share") - F.col("before_share")) / F.sqrt(
        pooled * (1 - pooled) * (1 / F.col("bl") + 1 / F.col("before_bl")))
    merged = (branches.filter(F.col("bl") > 0).withColumn("share", F.col("bb") / F.col("bl"))
              .withColumn("before_share", F.lag("share").over(siblings))
              .withColumn("before_bl", F.lag("bl").over(siblings)).withColumn("before_bb", F.lag("bb").over(siblings))
              .withColumn("new", F.when(F.col("before_share").isNull() | (F.col("share") == F.col("before_share")), 0)
                          .when(z >= SIMILAR_Z, 1).otherwise(0))
              .withColumn("merged", F.sum("new").over(siblings.rowsBetween(Window.unboundedPreceding, 0))))
    group = Window.partitionBy(*parents, "merged")
    return merged.select(*parents, name, F.sum("bl").over(group).alias("group_bl"),
                         F.sum("bb").over(group).alias("group_bb"))


_BRANCH = ["host", "t1", "t2", "deeper"]


def _deep_templates(tree: DataFrame) -> DataFrame:
    """``tree`` with ``ts``: the template's segments from the third on, found level by level.

    Below a branch of fewer than KEEP_PAGES pages nothing can be literal: it ends with ``**``.
    """
    tree, level = tree.withColumn("ts", F.array().cast("array<string>")), 0
    while True:
        most = (tree.filter(F.size("rest") > level).groupBy(*_BRANCH, "ts").count().agg(F.max("count")).first()[0])
        if most is None:
            return tree
        if most < KEEP_PAGES:
            return tree.withColumn("ts", F.when(F.size("rest") > level, F.concat("ts", F.array(F.lit("**"))))
                                   .otherwise(F.col("ts")))
        ends = tree.filter(F.size("rest") <= level)
        going = tree.filter(F.size("rest") > level).withColumn("s", F.get("rest", F.lit(level)))
        going = _literal_or_wildcard(going, [*_BRANCH, "ts"], "s", "t").withColumn("ts", F.concat("ts", F.array("t")))
        tree = materialize(ends.unionByName(going.drop("s", "t")), "url-levels")
        level += 1


def _deep_shares(tree: DataFrame, judged: DataFrame) -> DataFrame:
    """(host, t1, t2, deeper, ts, block_share) of every branch below two segments, from the root down."""
    leaves = materialize(tree.groupBy(*_BRANCH, "ts").agg(
        F.count("label").alias("bl"), F.coalesce(F.sum("label"), F.lit(0)).alias("bb")), "url-leaves")
    depth = leaves.agg(F.max(F.size("ts"))).first()[0] or 0
    of_root = leaves.groupBy(*_BRANCH).agg(F.sum("bl").alias("parent_bl"))
    above = judged.join(of_root, _BRANCH).select(
        *_BRANCH, F.array().cast("array<string>").alias("parent"), F.col("block_share").alias("p"), "parent_bl")
    found = above.select(*_BRANCH, F.col("parent").alias("ts"), F.col("p").alias("block_share"))
    for level in range(1, depth + 1):
        key = [*_BRANCH, "parent"]
        nodes = (leaves.filter(F.size("ts") >= level).withColumn("ts", F.slice("ts", 1, level))
                 .groupBy(*_BRANCH, "ts").agg(F.sum("bl").alias("bl"), F.sum("bb").alias("bb"))
                 .withColumn("parent", F.slice("ts", 1, level - 1)))
        prior = F.when(F.col("group_bl") == F.col("parent_bl"), F.col("p")).otherwise(
            _smoothed("group_bb", "group_bl", "p"))
        own = F.when(F.col("bl") == F.col("group_bl"), F.col("prior")).otherwise(_smoothed("bb", "bl", "prior"))
        here = materialize(
            nodes.join(_merged_siblings(nodes, key, "ts"), [*key, "ts"], "left").fillna(0, ["group_bl", "group_bb"])
            .join(above, key).withColumn("prior", prior).select(*_BRANCH, "ts", own.alias("block_share"), "bl"),
            "url-shares")
        found = found.unionByName(here.drop("bl"))
        above = here.select(*_BRANCH, F.col("ts").alias("parent"), F.col("block_share").alias("p"),
                            F.col("bl").alias("parent_bl"))
    return found


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (NULL without one), verdict, template, block_share.

    Needs ``page_id`` and ``url``. A NULL url or one without ``://`` has an
    empty host and path and is judged like any other page without a rule.
    Without any labelled page, nothing is blocked. Repeated rows are judged as
    often as they occur; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = (parsed.withColumn("rule", _longest_fit(rules, 0)).withColumn("by_rule", _longest_fit(rules, 1))
                .withColumn("label", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)))
    segments = F.split("path", "/")
    for i in (1, 2):
        labelled = labelled.withColumn(f"s{i}", F.coalesce(F.get(segments, F.lit(i)), F.lit("")))
    tree = _literal_or_wildcard(labelled, ["host"], "s1", "t1")
    tree = _literal_or_wildcard(tree, ["host", "t1"], "s2", "t2")
    n = F.size(segments) - F.when(F.element_at(segments, -1) == "", 1).otherwise(0)  # without a slash at the end
    tree = (tree.withColumn("deeper", F.size(segments) > 3)
            .withColumn("rest", F.slice(segments, F.lit(4), F.greatest(n - 3, F.lit(0)))))
    tree = _deep_templates(tree)

    leaves = tree.groupBy("host", "t1", "t2", "deeper").agg(  # one row per template
        F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    overall = leaves.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0))).scalar()
    anywhere = leaves.groupBy("t1").agg(F.sum("labelled").alias("any_labelled"), F.sum("blocked").alias("any_blocked"))
    branches = leaves.groupBy("host", "t1").agg(F.sum("labelled").alias("bl"), F.sum("blocked").alias("bb"))

    merged = _merged_siblings(branches, ["host"], "t1")

    judged = (leaves.join(anywhere, "t1").join(merged, ["host", "t1"], "left")
              .withColumn("p0", overall)
              .withColumn("p1", _smoothed("any_blocked", "any_labelled", "p0"))
              .fillna(0, ["group_bl", "group_bb"])
              .withColumn("p2", _smoothed("group_bb", "group_bl", "p1"))
              .withColumn("block_share", _smoothed("blocked", "labelled", "p2"))
              .select("host", "t1", "t2", "deeper", "block_share"))
    out = tree.join(_deep_shares(tree, judged), [*_BRANCH, "ts"])
    below = F.when(F.size("ts") > 0, F.concat(F.lit("/"), F.array_join("ts", "/"))).when(
        F.col("deeper"), F.lit("/**")).otherwise(F.lit(""))
    template = F.concat("host", F.when(F.col("t1") != "", F.concat(F.lit("/"), "t1")).otherwise(F.lit("")),
                        F.when(F.col("t2") != "", F.concat(F.lit("/"), "t2")).otherwise(F.lit("")), below)
    by_method = F.when(F.col("block_share") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"),
                      template.alias("template"), "block_share")
