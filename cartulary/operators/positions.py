"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut


def number_within(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based ``name`` of every row in its group, without putting a group into one task.

    The rows are range-partitioned on group and order, so a large group spans
    many tasks; a row's number is its place in its task plus the rows of its
    group in earlier tasks. Only the counts per (task, group) meet in a window.
    The ranged rows are cut from their lineage first: both passes must see the
    same partition borders.
    """
    ranged = cut(
        df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33))
    )
    counts = ranged.groupBy(*group, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(g).alias(f"_group_{i}") for i, g in enumerate(group)]
    offsets = counts.select(*renamed, F.col("_part").alias("_at"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Null-safe: rows without a group value form a group of their own.
    same = F.col("_part") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{i}"))
    return ranged.join(offsets, same).select(
        *df.columns, (F.col("_seq") - F.col("_first") + F.col("_before") + 1).alias(name))
