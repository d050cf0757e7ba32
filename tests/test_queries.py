"""Every registered query beside its SQL on the smallest tables; queries without SQL must run and give rows."""

import pytest

import __spark_entry__ as entry
from tests.sql_check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 140


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLES:
        assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0
