"""The registered corpus queries: thin digests of the operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volsignals.llm import embeddings, fill_middle, fingerprints, licenses, line_dedup, mixing, near_dedup, oracles, packing, pii, prefix_trie, quality, substring_dedup, token_counts
from volsignals.llm.common import table, vocabulary, whole_text


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = whole_text()
    return out.select(
        "doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "class_texts", "kept")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_source_mix, op4_near_dedup, op5_fingerprints, op6_quality, op7_license_scan, op8_embedding_dedup, op9_substring_dedup, op10_line_dedup, op11_fill_in_middle, op12_prefix_trie, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
