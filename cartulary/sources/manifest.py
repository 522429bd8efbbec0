"""Is an extract one point in time: a manifest beside its tables, checked before capture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..keys import SNAPSHOT

Tables = dict[str, DataFrame]


def counts(raw: Tables) -> DataFrame:
    """``catalog_id, snapshot_id, part, rows`` of every table of an extract."""
    return reduce(DataFrame.unionByName, [
        frame.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("rows")).select(*SNAPSHOT, F.lit(name).alias("part"), "rows") for name, frame in raw.items()])


def extract_findings(raw: Tables, manifest: DataFrame) -> DataFrame:
    """``catalog_id, snapshot_id, flaw, detail`` of extracts that are not whole.

    ``manifest`` has ``catalog_id, snapshot_id, part, rows, mark``: what was
    written of each table, and the transaction it was read in. A snapshot is
    torn if its tables were read in several transactions, if a table is not in
    the manifest or has another number of rows, and if the manifest names no
    table of it at all.
    """
    found = counts(raw).withColumnRenamed("rows", "found")
    both = manifest.join(found, [*SNAPSHOT, "part"], "full")
    rows = both.select(
        *SNAPSHOT,
        F.when(F.col("rows").isNull(), "table_unlisted").when(F.coalesce("found", F.lit(0)) != F.col("rows"), "rows_differ").alias("flaw"),
        F.concat(F.col("part"), F.lit(": "), F.coalesce(F.col("found").cast("string"), F.lit("0")), F.lit(" of "), F.coalesce(F.col("rows").cast("string"), F.lit("none"))).alias("detail"),
    ).filter("flaw IS NOT NULL")
    marks = manifest.groupBy(*SNAPSHOT).agg(F.count_distinct("mark").alias("marks"), F.count_if(F.col("mark").isNull()).alias("unmarked"))
    mixed = marks.filter("marks != 1 OR unmarked > 0").select(*SNAPSHOT, F.lit("several_moments").alias("flaw"), F.concat_ws(" ", F.col("marks").cast("string"), F.lit("marks")).alias("detail"))
    return rows.unionByName(mixed)


def whole_extracts(raw: Tables, findings: DataFrame) -> Tables:
    """The extract tables without torn snapshots."""
    torn = findings.select(*SNAPSHOT).distinct()
    return {name: frame.join(torn, SNAPSHOT, "left_anti") for name, frame in raw.items()}
