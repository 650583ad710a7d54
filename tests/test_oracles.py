"""Every registered telemetry query against its SQL."""

import pytest

import __spark_entry__ as contract
from compare import duck, spark_bag, sql_bag
from packetloom.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    with duck(FOLDER) as c:
        yield c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_bag(catalog.queries()[name](spark, FOLDER))
    expected_columns, expected = sql_bag(con, oracles.oracle_sql()[name])
    assert columns == expected_columns
    assert expected, "the query returns nothing on the test tables"
    assert rows == expected


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
