"""Registered queries of the operators, over the whole intended table each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelens.llm.collocations import mine_collocations
from tradelens.llm.common import read, ship_package
from tradelens.llm.decontaminate import judge_leaks
from tradelens.llm.jaccard_join import jaccard_components
from tradelens.llm.language_id import identify
from tradelens.llm.line_dedup import dedup_report
from tradelens.llm.minhash_dedup import near_duplicates
from tradelens.llm.oracle import ORACLE_SQL  # noqa: F401  (re-exported)
from tradelens.llm.packing import packed_digest
from tradelens.llm.quality_mil import score_quality
from tradelens.llm.quality_rules import judge_quality
from tradelens.llm.sharding import sharding_digest
from tradelens.llm.token_alignment import alignment_digest
from tradelens.llm.token_counts import count_tokens
from tradelens.llm.url_templates import RULES, judge_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return read(spark, sf_dir, "documents")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), read(spark, sf_dir, "labels"), accept=0.3).select(
        "doc_id", "held_out", "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(_documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), limit=1024)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_digest(read(spark, sf_dir, "documents"), shards=24)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(_documents(spark, sf_dir), length=2048)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), width=3, percent=90).drop("h")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), RULES).withColumn("block_share", F.round("block_share", 9))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(_documents(spark, sf_dir))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_documents(spark, sf_dir), longest=5, least=100, absorb_percent=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_collocations": op13_collocations,
}
