"""Every corpus query that SQL can express against its SQL, over whole tables."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import duck, spark_bag, sql_bag
from packetloom.llm import oracles, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    with duck(FOLDER) as c:
        yield c


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_bag(queries.queries()[name](spark, FOLDER))
    expected_columns, expected = sql_bag(con, oracles.oracle_sql()[name])
    assert columns == expected_columns
    assert expected
    assert rows == expected


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_cross_joins(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert not re.search("CartesianProduct|NestedLoopJoin", df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
