"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mountwait.llm import (
    decontam, exact, lattice, nbsvm, pii, repetition, sharding, simhash, simplex, styletree, suffixes, transducer, trie)
from mountwait.llm.common import table
from mountwait.llm.oracles import ORACLES  # noqa: F401  (DuckDB SQL per query, where SQL can express it)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-processing-time sharding of all documents (law ``bytes``)."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the site style tree."""
    return styletree.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, by the compiled transducer."""
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every whole text, decoded again."""
    return lattice.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item within its error budget."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings removed from every whole text."""
    out = suffixes.remove_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules over every whole text."""
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "dup_line_chars", "dup_ngram_share")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text, learnt from ``labels.quality``."""
    return nbsvm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by fingerprints within 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations by truncation peeling."""
    return trie.nodes(table(spark, sf_dir, "conversations")).drop("node", "parent")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents by two-pass Bloom filtering."""
    return exact.mark(table(spark, sf_dir, "documents")).withColumn("text_sha256", F.lower(F.hex("text_sha256")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all 64-component vectors in exact integers, filtered by simplex projection."""
    return simplex.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_html_extraction, op2_token_counts, op3_sentencepiece, op4_decontamination,
        op5_quality_rules, op6_substring_dedup, op7_pii, op8_quality_classifier, op9_simhash,
        op10_sharding, op11_prefix_trie, op12_exact_dedup, op13_centroids)
}
