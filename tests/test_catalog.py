"""Every registered query against its SQL, over whole sample tables."""

import pytest

from orrery import catalog
from tests.conftest import DATA, duck, rows_of


@pytest.fixture(scope="module")
def connection():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, connection, name):
    assert rows_of(catalog.QUERIES[name](spark, sf).toPandas()) == rows_of(connection.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs_alike_twice(spark, sf, name):
    first = rows_of(catalog.QUERIES[name](spark, sf).toPandas())
    assert first[1] and first == rows_of(catalog.QUERIES[name](spark, sf).toPandas())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
