"""Every registered query beside its checking SQL on the smallest data set."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, database, sf_dir, name):
    ok, message, rows, _took = oracle.compare(spark, database, sf_dir, QUERIES[name], ORACLES.get(name))
    assert ok, message
    assert rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_checking_sql_names_known_queries():
    assert set(ORACLES) <= set(QUERIES)
