"""Every query with SQL gives the same whole result as the SQL."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import FOLDER

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], FOLDER) == []
