"""The training-data pipeline over `documents`: five stages, each written and read again."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from shelfline.llm.tables import small_batches, table
from shelfline.session import hand_over

# Near duplicates share 0.8 of their five-word n-grams; op6 has its own contract.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier trained on the labels."""
    model = quality_rules.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules.filter_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard_join.keep_one_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.mask_secrets(docs, secret_scan.train_randomness(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences."""
    return packing.pack_documents(docs)


def sized(stage):
    """The stage, with Arrow batches that fit long texts."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", sized(quality)),
    ("near_duplicates", sized(near_duplicates)),
    ("decontamination", sized(decontamination)),
    ("secret_scan", sized(secrets)),
    ("best_fit_packing", sized(best_fit_packing)),
]

# Trained classifiers and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = hand_over(stage(spark, docs, sf_dir), name)
    return docs
