"""Results do not hang on the number of cores at the time of a scan, on a preset folder, or on the lengths in a batch."""

import subprocess
import sys
from pathlib import Path

import pytest

from byline.llm import exact, multiindex, ordermin

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("drop", [exact.drop_exact_duplicates, ordermin.drop_near_duplicates])
def test_cores_may_change_between_building_and_reading(spark, tmp_path, drop):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(f"{w}{i % 60}" for w in words), "tag") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, _tag string").repartition(24).write.parquet(str(tmp_path / "d"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
        left = drop(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = left.collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert left.columns == ["doc_id", "text", "_tag"] and {r._tag for r in got} == {"tag"}
    assert len(got) == 60 and len({r.text for r in got}) == 60


def test_vectors_of_two_lengths_in_two_files(spark, tmp_path):
    rows = [(i, [float(i % 5 + 1), 1.0, 2.0, float(i % 5)]) for i in range(40)] + [(100 + i, [1.0, float(i), 3.0]) for i in range(20)]
    spark.createDataFrame(rows[:40], "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "v"))
    spark.createDataFrame(rows[40:], "vec_id long, embedding array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    got = {r.vec_id: r for r in multiindex.near_duplicates(spark.read.parquet(str(tmp_path / "v")), target_recall=1).collect()}
    assert len(got) == 60 and all(got[100 + i].n_links == 0 and got[100 + i].kept for i in range(20))
    assert all(got[i].n_links >= 7 for i in range(40))


def test_a_session_without_a_folder_gets_one(tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "spark-defaults.conf").write_text("spark.ui.enabled false\n")
    code = ("from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').getOrCreate();"
            "from byline.llm import exact; d = s.createDataFrame([(1, 'a'), (2, 'a')], 'doc_id long, text string');"
            "assert s.conf.get('spark.checkpoint.dir', None) is None;"
            "assert [r.doc_id for r in exact.drop_exact_duplicates(d).collect()] == [2]; print('fine')")
    import os
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
