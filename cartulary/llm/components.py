"""Connected components of an edge table, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import land


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) of all nodes of the edges ``a, b``.

    Each round takes the smallest label around a node, its own among them, and
    then the label of that label, so chains shorten by more than half; rounds
    end when nothing changes. Edges of a hub meet in split join partitions and
    are combined before the shuffle; every round is landed.
    """
    told = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"))
    both = land(edges.select(F.explode(told).alias("__e")).select("__e.a", "__e.b").distinct(), "edges")
    labels = land(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(
            F.min("component").alias("__next"), F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("__before"))
        jump = labels.select(F.col("node").alias("__at"), F.col("component").alias("__jump"))
        moved = land(around.join(jump, F.col("__next") == F.col("__at"), "left").select(
            F.col("a").alias("node"), F.least("__next", F.coalesce("__jump", "__next")).alias("component"), "__before"), "labels")
        labels = moved.select("node", "component")
        if not moved.filter("component != __before").limit(1).count():
            return labels
