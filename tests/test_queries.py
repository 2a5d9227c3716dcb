"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    assert differences(QUERIES[name](spark, FOLDER), db, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 6000
