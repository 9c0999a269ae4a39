"""The corpus pipeline: toxicity, quality rules, near duplicates, mixing, BPE encoding, each over what the one before kept.

Null and empty texts fail the quality rules; of repeated rows one stays; rows with one doc_id but other texts are
judged by themselves; extra columns, whatever their names, are kept up to the last stage; an empty table gives an
empty result; without labels nothing is toxic and the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, jaccard, mixing, rules, toxicity
from quernel.llm.common import cut, drop, table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles one stays: that with the smallest doc_id."""
    return jaccard.keep_one_each(docs, width=5, percent=80)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix_documents(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    return bpe.digest_documents(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality_rules", stage_quality_rules),
    ("ngram_jaccard", stage_ngram_jaccard),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: Several stages (a trained network, the mix's order, token ids) can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Each stage's result but the last is written to the shared folder, and removed when the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
