"""Every registered query against its SQL counterpart on the smallest driver data."""

from __future__ import annotations

from pathlib import Path

import __spark_entry__ as entry
import pytest
from cartulary.queries import REGISTRY
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver data not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(REGISTRY) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    same, text = compare(spark, con, name, entry.queries()[name], SQL[name], FOLDER)
    assert same, text


def test_flagship(spark):
    assert entry.entry(spark).columns == ["catalog_id", "relation_id", "code", "sections"]
