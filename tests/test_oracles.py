"""Every registered query equals its DuckDB statement on the smallest tables.

``FETTLE_SF_DIR`` names other tables, ``FETTLE_ONLY`` keeps the queries whose name contains it.
"""

from __future__ import annotations

import os

import pytest

from fettle.plans import catalog
from tests.compare import check, connect

SF = os.environ.get("FETTLE_SF_DIR", "/root/testdata/sf0.001")
ONLY = os.environ.get("FETTLE_ONLY", "")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if ONLY in n])
def test_query_equals_sql(spark, con, name):
    ok, note = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
