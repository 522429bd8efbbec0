"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, blocks, bpe, classifier, hilbert, minhash, mixing, packing, pieces, repetition, search, suffixes, variants
from .base import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    """The public vocabulary that the token queries use; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), tokenizer_file())


def op2_zip_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archived(spark.read.parquet(f"{folder}/pages.parquet"))


def op3_batched_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.coded(documents(spark, folder), tokenizer_file())


def op4_bottom_k_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(documents(spark, folder))


def op5_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.scored(documents(spark, folder))


def op6_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.hilbert_shards(documents(spark, folder))


def op7_repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.judged(documents(spark, folder))


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.trimmed(documents(spark, folder))


def op9_subword_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    return classifier.scored(docs, classifier.train(docs, labels))


def op10_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.exact_groups(documents(spark, folder))


def op11_trie_node_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(documents(spark, folder))


def op12_fp_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces.token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


REGISTRY: dict[str, Query] = {f.__name__: f for f in (op1_sum_of_squares_packing, op2_zip_archives, op3_batched_bpe, op4_bottom_k_near_dedup, op5_context_mixing, op6_hilbert_sharding, op7_repetition_rules, op8_suffix_array_dedup, op9_subword_classifier, op10_block_naming, op11_trie_node_pairs, op12_fp_tree_search, op13_piece_counts)}
