"""Lines are dealt once, by their order, and hashes of a history once, by relation; checks of a snapshot move flags, not hashes."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_lazy import shuffles

from cartulary.operators import diff
from cartulary.plans import reports
from cartulary.sources import derived

STAR = {
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", [(1, 1, "F", 5.0, "5-LOW"), (2, 1, "O", 7.0, "1-URGENT"), (2, 1, "O", 7.0, "1-URGENT"), (None, 1, "F", 1.0, None)]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 3, "BUILDING")]),
    "supplier": ("s_suppkey long, s_nationkey int, s_name string", [(4, 3, "x"), (5, 2, "y")]),
    "lineitem": (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double",
        [(1, 1, 8, 4, "A", "O", 2.0), (1, 1, 8, 5, "N", "F", 3.0), (1, 2, 9, 5, "R", "F", 1.0), (2, 1, 7, 5, None, "O", 4.0), (None, 1, 7, 4, "A", "O", 9.0)])}


def test_lines_are_dealt_once(spark, tmp_path):
    for name, (schema, rows) in STAR.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    made = derived.derive(spark, str(tmp_path), str(tmp_path / "out"))
    found = sorted((r.ver, r.k, r.ln, r.p, r.s, r.rf, r.ls, r.qty) for r in made["line_base"].collect() if r.rf)
    each = [(1, 1, 8, 4, "N", "O", 5), (1, 2, 9, 5, "R", "F", 1)]
    assert found == [(ver, *row) for ver in (1, 2) for row in each]
    # The order that is there twice has its line twice in each snapshot; lines without an order have none.
    assert made["line_base"].count() == 8
    frames = {"lineitem": derived._lines(spark, str(tmp_path)), "order_base": made["order_base"], "supplier": spark.read.parquet(f"{tmp_path}/supplier.parquet")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Lines and orders by order, then both sides by supplier.
        assert shuffles(derived._run(spark, derived.STATEMENTS["line_base"], frames)) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checks_move_flags_not_hashes(spark):
    relation = "catalog_id string, snapshot_id string, relation_id string, schema string"
    tables = {
        "relations": spark.createDataFrame([("a", "s", "x.1", "x", "1", "table"), ("b", "s", "x.1", "x", "1", "table"), ("c", "s", "x.1", "x", None, "table"), ("d", "s", "x.1", "x", "1", "table")], relation + ", name string, kind string"),
        "hashes": spark.createDataFrame([("a", "s", "x.1", "x", "h", "d"), ("b", "s", "x.1", "x", "h", None), ("c", "s", "x.1", "x", "h", "d")], relation + ", hash string, doc_hash string"),
        "enums": spark.createDataFrame([], "catalog_id string, snapshot_id string, enum_id string, schema string, name string, values array<string>, external boolean"),
        "scopes": spark.createDataFrame([(c, "s", "x", 1) for c in "abcd"], "catalog_id string, snapshot_id string, schema string, position int")}
    stored = spark.createDataFrame([(c, "s", ["x"], "r") for c in "abcd"], "catalog_id string, snapshot_id string, schemas array<string>, revision string").withColumns({"format": F.lit(1), "coverage": F.lit("y")})
    checks = reports.snapshot_checks(tables, stored)
    assert {r.catalog_id: r.ok for r in checks.filter(F.col("check") == "relations").collect()} == {"a": True, "b": False, "c": False, "d": False}
    # Both hashes are read once for the revision, and once as a flag.
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "AS unhashed" in plan


def test_a_history_is_dealt_once(spark):
    rows = [(c, s, "x.1", h) for c, s, h in (("a", "s1", "h"), ("a", "s2", "h"), ("a", "s3", "i"), ("a", "s4", "h"), ("b", "s1", "h"), ("b", "s3", None))]
    rows = spark.createDataFrame(rows, "catalog_id string, snapshot_id string, relation_id string, hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = diff.history_intervals(rows, rows)
        # The list of snapshots takes two.
        assert shuffles(found) == 3
        assert sorted(map(str, ((r.catalog_id, r.hash, r.valid_from, r.valid_to, r.snapshots) for r in found.collect()))) == sorted(map(str, [
            ("a", "h", "s1", "s3", 2), ("a", "i", "s3", "s4", 1), ("a", "h", "s4", None, 1), ("b", "h", "s1", "s3", 1), ("b", None, "s3", None, 1)]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
