"""Corpus pipeline: five stages over ``documents``, each calling one operator.

Each stage gets what its predecessor kept.  All but the last return the
columns of the documents; the last returns the token ids, with the check that
they decode to the very text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mountwait.llm import decontam, lattice, nbsvm, pii, simhash
from mountwait.llm.common import table
from mountwait.session import cut_lineage

MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    return pii.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled token ids of each text, decoded again to check them."""
    path = public_tokenizers.path(MODEL)
    src = docs.select("doc_id", "lang", "source", "text")
    both = lattice.decode(lattice.encode_sampled(src, path), path)
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("private", private),
          ("tokenize", tokenize)]

# The classifier's fit, fingerprints, edit distances and sampling are not SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
