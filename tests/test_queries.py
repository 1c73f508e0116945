"""Every registered query with SQL gives the SQL's rows; the others run and give rows."""

from __future__ import annotations

import os

import pytest

from tests.oracle import connect, difference
from tracelake.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal(spark, con, name):
    assert difference(spark, con, name, registry.QUERIES[name], registry.ORACLE_SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
