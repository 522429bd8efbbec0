"""Note pages as whole-text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.idents import parse_name, qualified_id


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages below ``path/<catalog_id>/``, keyed by the relation id each one declares.

    Files without a readable ``"table"`` entry are not pages and are left out.
    """
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    quoted = F.regexp_extract("value", r'"table"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    declared = F.get_json_object(F.concat(F.lit('{"t":'), quoted, F.lit("}")), "$.t")
    named = files.withColumn("parts", parse_name(declared)).filter(F.size("parts") == 2)
    return named.select(
        F.element_at(F.split("path", "/"), -2).alias("catalog_id"),
        qualified_id(F.get("parts", 0), F.get("parts", 1)).alias("relation_id"),
        F.get("parts", 0).alias("schema"), "path", F.col("value").alias("text"))
