"""Text queries against their SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

from fundflow.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    ok, rows, _, note = compare(spark, con, sf, name, queries.QUERIES, queries.ORACLES)
    assert ok and rows, note
