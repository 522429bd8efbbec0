"""The relation graph: inverse references, external targets, one-hop neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..keys import RELATION, SNAPSHOT
from .positions import number_within


def _captured(relations: DataFrame) -> DataFrame:
    return relations.select(*SNAPSHOT, F.col("relation_id").alias("ref"))


def referenced_by(foreign_keys: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per foreign key of a captured relation on its captured target.

    Long form: a hub may be the target of any number of foreign keys, so the
    entries are never collected. Their order is ``(from_relation, name)``.
    """
    return (
        foreign_keys.join(_captured(relations), SNAPSHOT + ["ref"], "left_semi")
        .select(*SNAPSHOT, F.col("ref").alias("relation_id"), F.col("relation_id").alias("from_relation"),
                "name", "columns", "ref_columns")
    )


def external_targets(foreign_keys: DataFrame, relations: DataFrame) -> DataFrame:
    """Targets that foreign keys name but the snapshot does not hold, once per referencing relation."""
    return (
        foreign_keys.join(_captured(relations), SNAPSHOT + ["ref"], "left_anti")
        .select(*RELATION, "ref").distinct()
    )


def edges(foreign_keys: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct pairs ``relation_id, neighbor`` of captured relations one foreign key apart, in both directions."""
    inside = foreign_keys.join(_captured(relations), SNAPSHOT + ["ref"], "left_semi")
    way = lambda a, b: F.struct(F.col(a).alias("relation_id"), F.col(b).alias("neighbor"))
    return inside.select(*SNAPSHOT, F.inline(F.array(way("relation_id", "ref"), way("ref", "relation_id")))).distinct()


def neighbors(graph: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """Captured relations one edge of ``graph`` away from the seeds of each request, in order of their ids.

    ``seeds`` holds ``request_id`` and relation keys. All neighbours are given,
    with their position; a hub may have any number of them, so they are
    numbered over range partitions. A caller's ``cap`` keeps the first ones and
    ``omitted`` tells how many more there are. That count is its own aggregate
    and the cut a plain ``row_number <= cap``, which Spark applies before the
    shuffle.
    """
    wanted = seeds.select(*SNAPSHOT, "request_id", "relation_id")
    request = SNAPSHOT + ["request_id"]
    found = (
        wanted.join(graph, RELATION).select(*request, "neighbor").distinct()
        .join(wanted.withColumnRenamed("relation_id", "neighbor"), request + ["neighbor"], "left_anti")
    )
    if cap is None:
        return number_within(found, request, ["neighbor"]).select(*request, "position", "neighbor", F.lit(0).cast("bigint").alias("omitted"))
    totals = found.groupBy(*request).agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy(*request).orderBy("neighbor")
    kept = found.withColumn("position", F.row_number().over(order).cast("bigint")).filter(F.col("position") <= cap)
    return kept.join(totals, request).select(
        *request, "position", "neighbor", F.greatest(F.col("total") - cap, F.lit(0)).alias("omitted"))
