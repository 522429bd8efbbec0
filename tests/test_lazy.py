"""What a query does not read is neither captured nor shuffled for it; and it costs one shuffle where one will do."""

from __future__ import annotations

import os

from model import column, foreign_key, relation, snapshot
from pyspark.sql import functions as F
from test_capture import extracts

from cartulary.functions.hashing import LANES
from cartulary.operators import hashes, scans
from cartulary.plans.capture import capture
from cartulary.session import cut, small
from cartulary.sources.store import at


def shuffles(frame) -> int:
    """Exchanges by hash in the plan before it runs."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_only_what_is_asked_for_is_captured(spark, tmp_path):
    tables = capture(extracts(spark), str(tmp_path))
    assert os.listdir(tmp_path) == []
    assert at(tables, "s1")["columns"].count() > 0
    assert sorted(os.listdir(tmp_path)) == ["columns", "relations"]
    assert "hashes" in tables and sorted(os.listdir(tmp_path)) == ["columns", "relations"]


def test_columns_shuffle_once_a_side(spark, tmp_path):
    raw = {name: frame for name, frame in extracts(spark).items()}
    for name in ("attributes", "relations"):
        raw[name].write.parquet(str(tmp_path / name))
        raw[name] = spark.read.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        relations = raw["relations"].select("catalog_id", "snapshot_id", "oid", F.concat(F.lit("port."), "relname").alias("relation_id"))
        plan = scans.scan_columns(raw, relations)
        # Four among the types, which are few, and one of each large side: none for the types' sake, none for the numbers.
        assert shuffles(plan) == 6
        assert [r.ordinal for r in plan.filter("relation_id = 'port.tugs'").orderBy("ordinal").collect()] == [1, 2, 3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sections_meet_without_a_second_shuffle(spark):
    """Hashes by table equal those of one long list of rows; each child table is dealt once."""
    made = snapshot(
        spark, relations=[relation("a"), relation("b"), relation("empty")], columns=[column("a", 1, "x"), column("a", 2, "y"), column("b", 1, "x")],
        foreign_keys=[foreign_key("b", ["x"], "public.a")])
    found = {r.relation_id: r for r in hashes.relation_hashes(made).collect()}
    rows = hashes.section_rows(made).groupBy("relation_id", "section").agg(*hashes.lane_sums(F.col("row_hash")))
    by_rows = {(r.relation_id, r.section): r.h for r in rows.select("relation_id", "section", hashes.lane_digest().alias("h")).collect()}
    empty = spark.range(1).select(hashes.empty_digest()).first()[0]
    for name, row in found.items():
        for section in ("columns", "primaryKey", "uniques", "checks", "foreignKeys", "indexes", "enums"):
            assert row[f"s_{section}"] == by_rows.get((name, section), empty), (name, section)
    assert len(found) == 3 and LANES == 9
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = hashes.child_hashes(made)[:4]
        assert [shuffles(part) for part in parts] == [1, 1, 1, 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_side_is_broadcast_only_if_it_is_small(spark):
    hinted = lambda frame: "ResolvedHint" in frame._jdf.queryExecution().analyzed().toString()
    assert hinted(small(spark.range(5), 5)) and not hinted(small(spark.range(6), 5))


def test_cut_keeps_rows_in_columns(spark):
    rows = spark.createDataFrame([(1, None, ["a"]), (1, None, ["a"]), (None, "x", None)], "a int, b string, c array<string>")
    stored = cut(rows)
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))
    assert stored.inputFiles() and all(name.endswith(".zstd.parquet") for name in stored.inputFiles())
