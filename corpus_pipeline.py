"""The corpus pipeline: stages that each take and give documents.

Every stage works on all that the one before it kept. All but the last return
the columns of ``documents``; ``run`` writes each stage to the shared folder
and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartulary.llm import base, blocks, classifier, minhash, packing, suffixes
from cartulary.llm.queries import tokenizer_file
from cartulary.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; the model learns from labelled documents of this stage's input."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.select_quality(docs.select(*COLUMNS), classifier.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays: the longest original, then the smallest doc_id."""
    configure(spark)
    return blocks.drop_exact(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more."""
    configure(spark)
    return minhash.drop_near(docs.select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 100 that start earlier in the corpus are cut out; ``n_chars`` follows the text."""
    configure(spark)
    cut = suffixes.drop_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    configure(spark)
    return packing.packed(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality_classifier), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup), ("packing", packing_stage)]
#: Training and token ids are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = base.land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
