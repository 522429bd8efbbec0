"""What a comparison of hashes shuffles, and how often kept sums are dealt."""

from __future__ import annotations

from pyspark.sql import functions as F
from model import column, relation, snapshot
from test_lazy import shuffles

from cartulary.keys import SECTIONS
from cartulary.operators import diff
from cartulary.operators.hashes import used_enums
from cartulary.plans import incremental


def _hashes(spark, rows):
    return spark.createDataFrame(rows, "catalog_id string, relation_id string, schema string, hash string, " + ", ".join(f"s_{s} string" for s in SECTIONS))


def test_sections_are_compared_by_marks(spark):
    same = ["x"] * len(SECTIONS)
    old = _hashes(spark, [("a", "p.t", "p", "h1", *same), ("a", "p.u", "p", "h1", *same), ("a", "p.v", "p", "h1", None, *same[1:]), (None, "p.t", "p", "h1", *same)])
    new = _hashes(spark, [("a", "p.t", "p", "h2", *same[:-1], "y"), ("a", "p.u", "p", "h1", *same), ("a", "p.v", "p", "h2", "", *same[1:]), ("a", "p.w", "p", "h1", *same)])
    scopes = spark.createDataFrame([("a", "p"), (None, "p")], "catalog_id string, schema string")
    found = diff.relation_diff({"hashes": old}, {"hashes": new}, scopes)
    assert {(r.relation_id, r.code, tuple(r.sections or ())) for r in found.collect()} == {
        ("p.t", "relation_changed", (SECTIONS[-1],)), ("p.v", "relation_changed", (SECTIONS[0],)), ("p.w", "relation_added", ())}
    # Sides of the join hold marks; hex digits of sections stay where they are read.
    joined = found._jdf.queryExecution().optimizedPlan().toString().split("Join FullOuter")[0]
    assert "m_" in joined and f"s_{SECTIONS[0]}#" not in joined


def test_kept_sums_are_dealt_once(spark):
    sums = ["n", *[f"lane_{i}" for i in range(9)]]
    rows = [("a", "s1", f"p.t{i}", s, *range(1, 11)) for i in range(3) for s in ("columns", "indexes")]
    stored = spark.createDataFrame(rows, "catalog_id string, snapshot_id string, relation_id string, section string, " + ", ".join(f"{c} long" for c in sums))
    shop = snapshot(spark, "s2", relations=[relation("t")], columns=[column("t", 1, "id")])
    children = {name: shop[name] for name in ("columns", "constraints", "foreign_keys", "indexes")} | {"enums": used_enums(shop)}
    nothing = {name: frame.drop("snapshot_id").withColumn("change", F.lit(1)).filter(F.lit(False)) for name, frame in children.items()}
    relations = spark.createDataFrame(
        [("a", "s2", f"p.t{i}", "p", None, "table", None, None) for i in range(3)],
        "catalog_id string, snapshot_id string, relation_id string, schema string, comment string, kind string, view_definition string, partition_key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = incremental.hashes_from_lanes(incremental.refresh_lanes(stored, nothing, "s2"), relations)
        # Sums once, for both groupings and the join, and the relations.
        assert shuffles(found) == 2
        assert found.count() == 3 and found.select("s_columns").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
