"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

from byline.plans.catalog import QUERIES, SQL
from tests.compare import duck, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(con, SQL[name])
