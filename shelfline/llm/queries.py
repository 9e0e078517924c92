"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import (
    conversation_trie,
    decontaminate,
    jaccard_join,
    license_scan,
    packing,
    quality_lm,
    quality_rules,
    ranked_search,
    secret_scan,
    sharding,
    toxicity,
    url_filter,
    vector_search,
)
from shelfline.llm.oracles import ORACLES
from shelfline.llm.tables import small_batches, table


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_lm.classify_quality(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality_rules.train_quality(documents, table(spark, folder, "labels"))
    return quality_rules.judge_quality(documents, model)


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    known = url_filter.page_labels(pages, table(spark, folder, "labels"))
    return url_filter.filter_urls(pages, known)


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop(*decontaminate.ROW)


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, folder, "documents"))
    return found.drop("row_key", "copy", "root")


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return secret_scan.scan_secrets(documents, secret_scan.train_randomness(documents))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train_toxicity(documents, table(spark, folder, "labels"))
    return toxicity.score_toxicity(documents, model)


def op10_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, folder, "conversations"))


def op13_approximate_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest_neighbours(table(spark, folder, "embeddings"))


__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _sized(query: Query) -> Query:
    """The query, with Arrow batches that fit long texts."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        small_batches(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": _sized(op1_quality_classifier),
    "op2_quality_rules": _sized(op2_quality_rules),
    "op3_best_fit_packing": _sized(op3_best_fit_packing),
    "op4_url_filters": _sized(op4_url_filters),
    "op5_benchmark_decontamination": _sized(op5_benchmark_decontamination),
    "op6_ngram_jaccard_join": _sized(op6_ngram_jaccard_join),
    "op7_secret_scans": _sized(op7_secret_scans),
    "op8_sharding": _sized(op8_sharding),
    "op9_toxicity": _sized(op9_toxicity),
    "op10_license_scans": _sized(op10_license_scans),
    "op11_ranked_lexical_search": _sized(op11_ranked_lexical_search),
    "op12_conversation_prefix_trie": _sized(op12_conversation_prefix_trie),
    "op13_approximate_nearest_neighbours": _sized(op13_approximate_nearest_neighbours),
}
