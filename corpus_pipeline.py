"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import minhash, packing, quality, rules
from curatrix.llm.common import drop, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words a shingle, similarity 0.8)."""
    return minhash.keep(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models, MinHash and a vocabulary file are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; each result is written before the next begins, and the one before it deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        drop(before)
    return docs
