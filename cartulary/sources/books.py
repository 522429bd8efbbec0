"""Many pages in few files: books.

A page is a record of a text file, ended by a separator that no page may hold.
So millions of small pages are some large files, which Spark cuts to tasks by
size. A later read can leave out books that did not change since a moment; the
file source prunes them by their time before it opens them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Ends a page; a control character that cleaning takes out of every text.
SEPARATOR = "\x1e"
_HEAD = "catalog_id string, relation_id string, schema string, path string"


def write_books(pages: DataFrame, path: str, pages_per_book: int = 50_000) -> DataFrame:
    """Write ``catalog_id, relation_id, schema, path, text``; gives the pages that hold the separator and are not written.

    Pages lie in the order of catalog and path. A record is the page's keys as
    one line of JSON, then the page.
    """
    fit = ~F.contains("text", F.lit(SEPARATOR))
    head = F.to_json(F.struct("catalog_id", "relation_id", "schema", "path"))
    ordered = pages.filter(fit).repartitionByRange("catalog_id", "path").sortWithinPartitions("catalog_id", "path")
    ordered.select("catalog_id", F.concat(head, F.lit("\n"), F.col("text")).alias("value")).write.mode("overwrite").option(
        "lineSep", SEPARATOR).option("maxRecordsPerFile", pages_per_book).partitionBy("catalog_id").text(path)
    return pages.filter(~F.coalesce(fit, F.lit(False))).select("catalog_id", "relation_id", "path")


def read_books(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """``catalog_id, relation_id, schema, path, text`` and ``changed_at`` of all pages, or of books changed after ``since``."""
    books = spark.read.option("lineSep", SEPARATOR).schema("value string, catalog_id string").text(path)
    books = books.select("value", F.col("_metadata.file_modification_time").alias("changed_at"))
    if since is not None:
        books = books.filter(F.col("changed_at") > F.lit(since))
    cut = F.instr("value", "\n")
    head = F.from_json(F.substring("value", F.lit(1), cut - 1), _HEAD)
    return books.select(head.alias("head"), F.col("value").substr(cut + 1, F.length("value")).alias("text"), "changed_at").select("head.*", "text", "changed_at")
