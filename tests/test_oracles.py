"""Every registered query against its DuckDB oracle, on the smallest sample."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = set(entry.QUERIES)  # the optional queries have their own tests
QUERIES = {n: q for n, q in entry.queries().items() if n in CORE}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in CORE}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["bucket", "group_service", "group_error_code", "value"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = ORACLES.get(name)
    ok, message = compare(spark, con, name, QUERIES[name], sql, SF)
    assert ok, message
