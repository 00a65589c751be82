"""Registered queries of the pipeline operations and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_file
from .exact_search import top_k
from .html_text import extract_text
from .importance import resample
from .line_dedup import dedup_lines, kept_text
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .prefix_trie import conversation_trie
from .quality_rules import quality_report
from .repeated_spans import remove_repeats
from .secrets import secrets_report
from .token_counts import prefix_counts
from .toxicity import toxicity

TOKEN_LIMIT = 4096


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), TOKEN_LIMIT, keep_table=False)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_spans=False)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("n_ends")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_text(F.col("text"), F.col("dropped_runs"))
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_toxicity, op3_mix_sources, op4_exact_search, op5_best_fit_packing, op6_suffix_dedup, op7_html_extraction, op8_near_duplicates, op9_secret_scan, op10_quality_rules,
    op11_conversation_trie, op12_importance_resampling, op13_line_dedup)}
