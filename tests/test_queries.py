"""Every registered query against its SQL, on the given tables."""

import compare
import pytest

from plumbgrid.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def database():
    return compare.duck()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, database, name):
    assert compare.difference(spark, database, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 25
    assert set(contract.oracle_sql()) <= set(contract.queries())
    # Those without SQL belong to the text operators, whose own tests list them with the reason.
    assert set(QUERIES) <= set(contract.oracle_sql())
