"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroll.llm import (chat, contamination, html_tree, minhash, mixing, packed_ids, periodic, quality, repeats, resampling, toxicity,
                           urls, warc_zip)
from pressroll.llm.common import table
from pressroll.llm.sql import SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).drop("words")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract_text(table(spark, sf_dir, "pages"))


#: The conversation the contract adds: its texts look like control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn(
        "text", F.lit(CONTROL_TEXT))
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.repeated_spans(table(spark, sf_dir, "documents")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.token_ids(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency(table(spark, sf_dir, "documents")).drop("removed_lines")


def op11_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(table(spark, sf_dir, "pages")).drop("url")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.with_periodic_tails(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_minhash_dedup, op2_url_filter, op3_toxicity, op4_html_text, op5_chat_format, op6_decontamination, op7_repeated_strings, op8_source_mix, op9_token_ids, op10_quality_rules,
    op11_warc_zip, op12_resampling, op13_periodic_runs)}

