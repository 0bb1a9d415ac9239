"""Every registered query agrees with its SQL on DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(set(QUERIES) & set(ORACLES)))
def test_agrees(spark, con, key):
    ok, text = compare(spark, con, key, QUERIES[key], ORACLES.get(key), SMALL)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert {k for k in QUERIES if not k.startswith("op") and k != "pipeline"} <= set(ORACLES)
