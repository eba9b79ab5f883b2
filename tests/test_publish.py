"""Two tables switched by one pointer; row numbers that do not hang on the cores of a scan."""

import pytest
from pyspark.sql import functions as F

from byline.operators import publish, roster
from byline.sources import files


def _state(spark, root):
    papers = {r.doi: (r.title, r.status) for r in publish.read_published(spark, root, "papers").collect()}
    authors = sorted((r.paper_doi, r.rank, r.raw_name) for r in publish.read_published(spark, root, "paper_authors").collect())
    return papers, authors


def _batch(spark, papers, authors):
    return (spark.createDataFrame(papers, "doi string, title string, status string"),
            spark.createDataFrame(authors, "paper_doi string, rank int, raw_name string"))


def test_batches_merge_and_replace(spark, tmp_path):
    root = str(tmp_path / "root")
    assert _state(spark, root) == ({}, [])
    papers, authors = _batch(spark, [("a", "A", "COMPLETED"), ("b", "B", "SKIPPED")], [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    assert publish.publish(root, "one", papers, authors, papers, buckets=4)
    first = _state(spark, root)
    assert first == ({"a": ("A", "COMPLETED"), "b": ("B", "SKIPPED")}, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    papers, authors = _batch(spark, [("a", None, "ERROR"), ("c", "C", None)], [("c", 1, "w")])
    assert publish.publish(root, "two", papers, authors, papers)
    second = _state(spark, root)
    assert second == ({"a": ("A", "ERROR"), "b": ("B", "SKIPPED"), "c": ("C", "PROCESSING")}, [("b", 1, "z"), ("c", 1, "w")])
    assert not publish.publish(root, "two", papers, authors, papers) and _state(spark, root) == second
    assert publish.read_pointer(spark, root)["batches"] == ["one", "two"]


def test_a_batch_that_dies_between_the_tables_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    papers, authors = _batch(spark, [("a", "A", "COMPLETED")], [("a", 1, "x")])
    publish.publish(root, "one", papers, authors, papers, buckets=4)
    before = _state(spark, root)
    papers, authors = _batch(spark, [("a", "new", "COMPLETED")], [("a", 1, "new")])
    broken = authors.withColumn("raw_name", F.when(F.col("rank") > 0, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(root, "two", papers, broken, papers)
    assert (tmp_path / "root" / "versions" / "two" / "papers").is_dir() and _state(spark, root) == before
    assert publish.publish(root, "two", papers, authors, papers)
    assert _state(spark, root) == ({"a": ("new", "COMPLETED")}, [("a", 1, "new")])


def test_roster_rows_keep_their_numbers_when_cores_change(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02d}.csv").write_text("Name,Department,ID\n" + "".join(f"N{k}-{i},Law,{'e' + str(i % 9) if i % 3 == 0 else ''}\n" for i in range(40 + k)))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "6")
    try:
        loaded = roster.load_roster(files.read_roster(spark, str(tmp_path), delimiter=","))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
        once = sorted((r.row_index, r.name_zh, r.employee_id) for r in loaded.collect())
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
        again = sorted((r.row_index, r.name_zh, r.employee_id) for r in loaded.collect())
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    total = [f"N{k}-{i}" for k in range(12) for i in range(40 + k)]
    assert once == again and all(total[r[0]] == r[1] for r in once)
    assert len({r[2] for r in once}) == len(once) == sum(i % 3 != 0 for k in range(12) for i in range(40 + k)) + 3
