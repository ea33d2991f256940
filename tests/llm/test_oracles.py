"""The registered queries that SQL can state, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from fettle.llm import queries
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    ok, note = check(spark, connect(SF), SF, name, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, note


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
