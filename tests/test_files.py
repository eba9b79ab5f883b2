"""Files: order of lines over several files, quoted line breaks, whole sidecars."""

from byline.functions import text as T
from byline.operators import sinks
from byline.sources import files, pages, works


def test_rows_follow_file_names_not_sizes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Department,ID\nAnn,Physics,1\n")
    (tmp_path / "b.csv").write_text("Name,Department,ID\n" + "".join(f"Bo {i},Law,{i}\n" for i in range(500)))
    rows = files.read_roster(spark, str(tmp_path), delimiter=",").orderBy("row_index").collect()
    assert [r.name_zh for r in rows] == ["Ann"] + [f"Bo {i}" for i in range(500)]
    assert len({r.row_index for r in rows}) == 501


def test_doi_lines_follow_file_names(spark, tmp_path):
    (tmp_path / "a.txt").write_text("10.1/z\n# note\n\n10.1/a\n")
    (tmp_path / "b.txt").write_text("10.1/m\n" * 300)
    rows = files.read_doi_text(spark, str(tmp_path)).orderBy("input_pos").collect()
    assert [r.doi for r in rows] == ["10.1/z", "10.1/a"] + ["10.1/m"] * 300


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Name,Department,ID\n"Ann\nLee",Physics,1\nBo,Law,2\n')
    rows = files.read_roster(spark, str(path), delimiter=",", multi_line=True).orderBy("row_index").collect()
    assert [(r.name_zh, r.department, r.employee_id) for r in rows] == [("Ann\nLee", "Physics", "1"), ("Bo", "Law", "2")]


def test_nothing_is_cut_by_default(spark):
    text = "word1 " * 2000
    item = {"text": "x", "score": 1.0, "box": None}
    page = spark.createDataFrame([("d", "p.png", text, [item] * 700)],
                                 "doi string, image_path string, ocr_text string, ocr_items array<struct<text:string,score:double,box:string>>")
    whole, cut = sinks.sidecar_records(page).first(), sinks.sidecar_records(page, max_chars=4000, max_items=500).first()
    assert (len(whole.ocr_text), len(whole.ocr_items)) == (12000, 700) and (len(cut.ocr_text), len(cut.ocr_items)) == (4000, 500)
    tokens = page.select(T.fingerprint(page.ocr_text).alias("all"), T.fingerprint(page.ocr_text, 200, 500).alias("some")).first()
    assert len(tokens["all"]) == 2000 and len(tokens["some"]) == 83
    tags = "".join(f'<meta name="citation_author" content="A {i}">' for i in range(60))
    html = spark.createDataFrame([(1, tags)], "page_id long, html string")
    assert pages.extract_page_meta(html).count() == 60 and pages.extract_page_meta(html, {"author": 50}).count() == 50


def test_affiliations_are_objects_or_texts(spark, tmp_path):
    (tmp_path / "w.json").write_text(
        '{"doi": "a", "message": {"author": [{"given": "A", "family": "B", "affiliation": ["Plain U"]}, '
        '{"family": "C", "affiliation": [{"name": "Object U"}]}, {"family": "D", "affiliation": []}, {"family": "E"}]}}\n')
    got = works.registry_authors(files.read_registry_works(spark, str(tmp_path / "w.json"))).orderBy("pos").collect()
    assert [(r.name, r.affiliation) for r in got] == [("A B", "Plain U"), ("C", "Object U"), ("D", "Unknown"), ("E", "Unknown")]
