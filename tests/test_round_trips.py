"""What is written is read back: sidecars, results, reports, corrections, stored tables and new ids."""

import json

from pyspark.sql import functions as F

from byline import schemas
from byline.operators import memory, reports, roster, sinks
from byline.sources import files, pages

ITEMS = "array<struct<text:string,score:double,box:string>>"


def test_recognised_sidecars(spark, tmp_path):
    items = [("Ann Lee", 0.9, "[[1,2],[3,4]]"), (" ", 0.9, None), ("dim", 0.1, "[5,6,7,8]"), ("plain", None, None)]
    page = spark.createDataFrame([("10.1/a", "a.png", "Ann Lee\nplain", items), ("10.1/b", "", "x", [])], f"doi string, image_path string, ocr_text string, ocr_items {ITEMS}")
    sinks.write_sidecars(page, str(tmp_path / "out"))
    lines = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*.json")) for line in f.read_text().splitlines()]
    assert [x["doi"] for x in lines] == ["10.1/a"]
    (tmp_path / "10.1_a_ocr_sidecar.json").write_text(json.dumps(lines[0], indent=1))
    read = files.read_ocr_sidecars(spark, str(tmp_path), spark.createDataFrame([("10.1/a",)], "doi string"))
    assert read.first().ocr_text == "Ann Lee\nplain" and files.read_ocr_sidecars(spark, str(tmp_path), read.where("false")).count() == 0
    got = [(r.text, r.kept, [(p.x, p.y) for p in r.box or []]) for r in pages.recognised_items(read).orderBy("item").collect()]
    assert got == [("Ann Lee", True, [(1.0, 2.0), (3.0, 4.0)]), ("dim", False, [(5.0, 6.0), (7.0, 8.0)]), ("plain", True, [])]


def test_page_sidecars(spark, tmp_path):
    (tmp_path / "10.1_a_page_author_data.json").write_text(json.dumps({"doi": "10.1/a", "authors": [], "meta": {"citation_author": [" Ann Lee", "Bo Chen", "Ann Lee", ""]}}, indent=1))
    (tmp_path / "10.1_b_page_author_data.json").write_text(json.dumps({"doi": "10.1/b", "authors": [{"name": "Cy", "position": 1, "markers": "*"}]}))
    read = files.read_page_sidecars(spark, str(tmp_path))
    assert [(r.doi, r.pos, r.name) for r in pages.meta_only_authors(read).orderBy("pos").collect()] == [("10.1/a", 1, "Ann Lee"), ("10.1/a", 2, "Bo Chen")]
    assert [(r.doi, r.name, r.markers) for r in pages.sidecar_authors(read).collect()] == [("10.1/b", "Cy", "*")]


def test_results_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "é, \"x\""), ("b", 2, None)], "doi string, n int, t string")
    sinks.write_result_json(rows, str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "r")).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    reports.export_report(rows, str(tmp_path / "c"))
    again = files.read_table(spark, str(tmp_path / "c"), ",")
    assert {(r.doi, r.n) for r in again.collect()} == {("a", "1"), ("b", "2")}


def test_corrections_are_appended(spark, tmp_path):
    reviews = spark.createDataFrame([("d", ["tok"], "name", "fix", None, None), ("e", ["a", "b"], "aff", "fix", "auto", "n")],
                                    "doi string, tokens array<string>, error_type string, correction string, source string, notes string")
    for first in (1, 1 << 40):
        memory.append_corrections(reviews, str(tmp_path / "m"), first)
    stored = files.read_stored(spark, str(tmp_path / "m"), schemas.CORRECTION_MEMORY)
    rows = stored.collect()
    assert len(rows) == 4 == len({r.id for r in rows}) and {(r.doi, r.source, r.notes) for r in rows} == {("d", "manual", ""), ("e", "auto", "n")}


def test_new_roster_rows_get_ids_in_file_order(spark):
    rows = spark.createDataFrame([(5, "c"), (0, "a"), (200_000, "d"), (3, "b")], "row_index long, name_zh string").repartition(3)
    got = roster.assign_ids(rows, 100).orderBy("id").collect()
    assert [(r.id, r.name_zh) for r in got] == [(100, "a"), (101, "b"), (102, "c"), (103, "d")]
    assert roster.assign_ids(rows.where(F.lit(False)), 1).count() == 0
