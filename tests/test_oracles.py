"""Every registered query against its SQL statement, on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry
from fundflow.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    ok, _, _, note = compare(spark, con, sf, name, QUERIES, ORACLES)
    assert ok, note


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_whole_tables_are_read(spark, sf):
    """Statements without a filter on lines or events, and every row in the results."""
    from fundflow.plans import fixtures as X
    for name in ("cospend_edges", "components", "cluster_rollup", "cluster_listed", "cluster_service",
                 "clusters", "finding_cluster", "labels_best_per_address", "labels_categories",
                 "labels_replace"):
        for cut in ("l_quantity >= 40", "l_linenumber <> 3", "event_id % 3 = 0"):
            assert cut not in ORACLES[name]
    lines = X.table(spark, sf, "lineitem")
    assert QUERIES["labels_categories"](spark, sf).agg({"n": "sum"}).first()[0] == lines.count()
    keys = lines.selectExpr("concat_ws('|', l_suppkey, to_date(l_shipdate), l_partkey % 5) AS txid").distinct()
    assert X.cospend(spark, sf).select("txid").distinct().count() == keys.count()


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 32 + 76
