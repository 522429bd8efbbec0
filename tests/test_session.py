"""Session settings: what is broadcast by the size of its files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cartulary.session import BROADCAST, configure
from cartulary.sources.store import land

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def fresh(spark):
    """The session as it was before it was configured, and afterwards."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.unset(THRESHOLD)
    yield spark
    spark.conf.set(THRESHOLD, before)


def test_compressed_tables_are_not_broadcast_by_their_files(fresh, tmp_path):
    names = fresh.range(400_000).select(
        F.format_string("db%02d", F.col("id") % 25).alias("catalog_id"), F.format_string("finished.order_%d", F.xxhash64("id") % 1_000_000).alias("relation_id"))
    large, few = land(names, str(tmp_path / "large")), land(names.limit(50), str(tmp_path / "few"))
    files = sum(p.stat().st_size for p in (tmp_path / "large").rglob("*.parquet"))
    assert BROADCAST < files < 10 << 20
    configure(fresh)
    plan = lambda side: large.join(side, ["catalog_id", "relation_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(large.select("catalog_id", "relation_id", F.lit(1).alias("one")))
    assert "BroadcastHashJoin" in plan(few)


@pytest.mark.parametrize("own", ["-1", "100k", "256k"])
def test_lower_thresholds_stay(fresh, own):
    fresh.conf.set(THRESHOLD, own)
    configure(fresh)
    assert fresh.conf.get(THRESHOLD) == own
