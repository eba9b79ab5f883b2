"""Queries over odd documents give what their SQL gives."""

import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import spark_rows, sql_rows

ODD = [(1, ""), (2, None), (3, "a\n"), (4, "\n"), (5, "a\rb\x0bc d\ne\r\nf"), (6, "\n".join(f"line {i}" for i in range(12_000))),
       (7, "one line"), (8, " \n "), (11, "no page\nhere"), (12, "|\n||")]


@pytest.mark.parametrize("name", ["numbered_lines", "sidecar_records"])
def test_odd_documents_as_sql(spark, name):
    folder = tempfile.mkdtemp(prefix="odd-")
    path = os.path.join(folder, "documents.parquet")
    spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert spark_rows(entry.queries()[name](spark, folder)) == sql_rows(con, entry.oracle_sql()[name])
