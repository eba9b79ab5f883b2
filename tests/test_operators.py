"""Fixtures for decisions, fusion, roster, panels, regions, memory and sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from byline.operators import admission, author_text, decisions, details, fusion, memory, panels, regions, reports, roster, sinks
from byline.schemas import AUTHOR_EVIDENCE, EVIDENCE_COLUMNS, FACULTY, PAPERS
from byline.sources import files


def evidence(spark, rows):
    full = [tuple(r.get(c) for c in EVIDENCE_COLUMNS) for r in rows]
    return spark.createDataFrame(full, AUTHOR_EVIDENCE)


def test_fusion_cases(spark):
    reg = evidence(spark, [
        dict(doi="a", pos=1, name="Li, M.", author_order=1, affiliation="Unknown", is_corresponding=True,
             corresponding_source="openalex"),
        dict(doi="a", pos=2, name="A B", author_order=2, affiliation="Old"),
        dict(doi="b", pos=1, name="C D", author_order=1, affiliation="Unknown")])
    vis = evidence(spark, [
        dict(doi="a", pos=1, name="Other", author_order=1, affiliation="Wrong", source="other"),
        dict(doi="a", pos=2, name="Li M", author_order=2, affiliation="First", source="other"),
        dict(doi="a", pos=3, name="li m", author_order=3, affiliation="Filled", source="other"),
        dict(doi="b", pos=1, name="X Y", author_order=1, affiliations=["P ", "Q"], source="ocr-rule", is_co_first=True),
        dict(doi="c", pos=1, name="Only Vision", author_order=1)])
    got = {(r.doi, r.pos): r for r in fusion.fuse_registry_vision(reg, vis).collect()}
    li = got["a", 1]
    assert (li.affiliation, li.is_corresponding, li.source) == ("Filled", False, "other")
    assert got["a", 2].affiliation == "Old"  # aligned by order, known affiliation kept
    assert (got["b", 1].affiliation, got["b", 1].affiliations, got["b", 1].is_co_first) == ("P; Q", ["P ", "Q"], True)
    assert got["c", 1].is_corresponding is False and len(got) == 4


def test_hover_is_appended_once(spark):
    vis = evidence(spark, [dict(doi="a", pos=1, name="Ann Lee", author_order=1)])
    hov = evidence(spark, [dict(doi="a", pos=1, name="Ann Lee", has_mail_icon=True, author_order=1),
                           dict(doi="a", pos=2, name="Bo Chen"), dict(doi="a", pos=3, name="Bo  Chen")])
    rows = fusion.merge_hover(vis, hov).orderBy("pos").collect()
    assert [r.name for r in rows] == ["Ann Lee", "Bo Chen"]
    assert (rows[0].is_corresponding, rows[0].corresponding_source) == (True, "hover_icon")


@pytest.mark.parametrize("strategy,actions", [
    ("SKIP", ["process", "skip_cached", "cached_from_batch", "skip_processing", "process"]),
    ("PROMPT", ["process", "skip_cached", "cached_from_batch", "skip_processing", "process"]),
    ("OVERWRITE", ["process", "process", "cached_from_batch", "process", "process"])])
def test_admission(spark, strategy, actions):
    asked = spark.createDataFrame(list(enumerate([" 10.1/a ", "10.1/b", "10.1/a", "10.1/c", "10.1/d"])),
                                  "input_pos long, doi string")
    stored = spark.createDataFrame([("10.1/b", "COMPLETED"), ("10.1/c", "PROCESSING"), ("10.1/d", "ERROR")],
                                   "doi string, status string")
    rows = admission.admit_batch(asked, stored, strategy).orderBy("input_pos").collect()
    assert [r.action for r in rows] == actions
    assert [r.clear_authors for r in rows] == [False, strategy == "OVERWRITE", False, False, False]


def test_paper_status(spark):
    cases = {"a": ["COMPLETED"], "b": ["COMPLETED", "NEEDS_REVIEW"], "c": ["SKIPPED"], "d": ["COMPLETED", "SKIPPED"],
             "e": [None], "f": []}
    rows = [(doi, d, True) for doi, ds in cases.items() for d in ds]
    out = decisions.paper_statuses(
        spark.createDataFrame(rows, "doi string, decision string, roster_loaded boolean"),
        spark.createDataFrame([(d,) for d in [*cases, "g"]], "doi string"), spark.createDataFrame([("g",)], "doi string"))
    assert {r.doi: r.status for r in out.collect()} == {
        "a": "COMPLETED", "b": "NEEDS_REVIEW", "c": "SKIPPED", "d": "COMPLETED", "e": "SKIPPED", "f": "SKIPPED", "g": "ERROR"}


def test_roster_file(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, "roster.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("Name;Department;ID\nAnn Lee;Physics;00123\nAnn Lee;Physics;\nAnn Lee;Physics;\n;Physics;7\nBo;Art;00123\n"
                "Cy;Art;gen_6adf302f_1\n")
    rows = files.read_roster(spark, path)
    assert {(r.row_index, r.error) for r in roster.check_roster(rows).collect()} == {
        (3, "missing name"), (4, "duplicate id in file")}
    out = {r.row_index: r.employee_id for r in roster.load_roster(rows).collect()}
    assert out == {0: "00123", 1: "gen_6adf302f", 2: "gen_6adf302f_2", 5: "gen_6adf302f_1"}
    with open(path, "w") as f:
        f.write("Name,ID\nx,1\n")
    with pytest.raises(files.MissingColumn, match="Department"):
        files.read_roster(spark, path)


def test_doi_readers(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, "dois.txt")
    with open(path, "w") as f:
        f.write("# list\n 10.1/a \n\n10.1/b\n")
    assert [r.doi for r in files.read_doi_text(spark, path).collect()] == ["10.1/a", "10.1/b"]


PANEL = """Authors and Affiliations
Department of Physics, Example University, Town
Ann Lee & Bo Chen
Institute of Chemistry, Another University, City
José García
Contributions
A.B. and C.D. contributed equally.
Correspondence to Ann Lee or Bo Chen.
"""


def test_panels(spark):
    df = spark.createDataFrame([("d", 1, "Lee, A.", PANEL), ("d", 2, "Jose Garcia", PANEL), ("d", 3, "Al Bo", PANEL)],
                               "doi string, pos int, name string, text string")
    got = {r.pos: r for r in panels.extract_panel_affiliations(df).collect()}
    assert got[1].affiliations == ["Department of Physics, Example University, Town"]
    assert got[1].text_corresponding and not got[2].text_corresponding
    assert len(got[2].affiliations) == 2  # an accented single name is no author-list line
    assert got[3].is_co_first and not got[1].is_co_first


def test_memory(spark):
    rows = [(1, []), (5, ["department", "medicine", "journal", "volume"]), (2, ["department", "medicine", "example"]),
            (4, ["Department", "Medicine", "journal", "volume"]), (3, ["department", "medicine", "journal", "volume"])]
    mem = spark.createDataFrame(rows, "id long, layout_fingerprint array<string>")
    ask = spark.createDataFrame([("d", ["department", "medicine", "example"]), ("e", [])], "doi string, tokens array<string>")
    got = [(r.place, r.id, round(r.score, 4)) for r in memory.similar_cases(ask, mem).orderBy("place").collect()]
    assert got == [(1, 2, 1.0), (2, 3, 0.4), (3, 4, 0.4)]
    assert {r.doi: r.memory_hint_count for r in memory.memory_signals(ask, mem).collect()} == {"d": 3, "e": 0}


def test_reports_edge_cases(spark):
    schema = "doi string, faculty_name string, employee_id string, department string"
    rep = spark.createDataFrame([("1", "A", "1", "X"), ("2", "A", "2", "W"), ("2", "B", "3", None)], schema)
    assert tuple(reports.report_counts(rep).first()) == (2, 3, "W")
    assert tuple(reports.report_counts(rep.where("false")).first()) == (0, 0, "N/A")
    assert [tuple(r) for r in reports.top_staff(rep).collect()] == [("A", 2), ("B", 1)]


def test_write_paper_authors(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "authors")
    row = "paper_doi string, rank int, raw_name string"
    def put(rows, dois):
        sinks.write_paper_authors(spark.createDataFrame(rows, row), spark.createDataFrame([(d,) for d in dois], "doi string"), path, 4)
    put([("a", 1, "A1"), ("a", 2, "A2"), ("b", 1, "B1")], ["a", "b"])
    put([("a", 1, "New")], ["a", "c"])
    read = lambda: {tuple(r) for r in spark.read.parquet(path).select("paper_doi", "rank", "raw_name").collect()}
    assert read() == {("a", 1, "New"), ("b", 1, "B1")}
    put([], ["a", "b"])
    assert not os.listdir(path) or read() == set()


def test_parse_box(spark):
    df = spark.createDataFrame([("[[1,2],[3,4]]",), ("[1,2,3,4]",), (None,)], "b string")
    got = [r[0] and [tuple(p) for p in r[0]] for r in df.select(sinks.parse_box(F.col("b"))).collect()]
    assert got == [[(1.0, 2.0), (3.0, 4.0)], [(1.0, 2.0), (3.0, 4.0)], None]


def test_paper_detail_parts(spark):
    papers = spark.createDataFrame([("a", "t", "j", "2020", None, "COMPLETED", None)], PAPERS)
    authors = spark.range(25000).select(
        F.lit("a").alias("paper_doi"), (F.col("id") + 1).cast("int").alias("rank"), F.lit("n").alias("raw_name"),
        F.lit("x").alias("raw_affiliation"), F.lit(None).cast("array<string>").alias("raw_affiliations"),
        F.lit(False).alias("is_corresponding"), F.lit(False).alias("is_co_first"), F.lit(None).cast("long").alias("matched_faculty_id"))
    rows = details.paper_detail(papers, authors).orderBy("part").collect()
    assert [len(r.authors) for r in rows] == [10000, 10000, 5000] and rows[2].authors[0]["rank"] == 20001
    assert FACULTY


def test_long_lists_are_kept_whole(spark):
    units = [f"Department of Number{i}, Example University" for i in range(9)]
    row = spark.createDataFrame([("\n".join(units), " ".join(f"{i} Department of things" for i in range(1, 13)))], "a string, b string").select(
        panels.affiliations_from_text(F.col("a")).alias("all"), panels.affiliations_from_text(F.col("a"), 6).alias("six"),
        regions.numbered_units(F.col("b")).alias("n"), regions.numbered_units(F.col("b"), 10).alias("ten")).first()
    assert row["all"] == units and row["six"] == units[:6] and (row["n"], row["ten"]) == (12, 10)


def test_head_pairs_without_a_list_read_every_line(spark):
    text = "\n".join(["plain words here"] * 14 + ["Ann Lee 1,2"])
    known = F.array().cast("array<int>")
    read = lambda **k: author_text._head_pairs(F.col("t"), F.lit(9), known, **k)
    row = spark.createDataFrame([(text,)], "t string").select(read().alias("all"), read(max_lines=12).alias("few")).first()
    assert len(row["all"]) == 1 and len(row["few"]) == 0


def test_fusion_moves_both_lists_once(spark):
    """Author lists are aligned after one exchange by paper, lone papers and rows without a paper included."""
    row = ("10.1/a", 1, "Ann Lee", None, None, 1, False, False, None, None, None, None, None)

    def rows(*given):
        return spark.createDataFrame([tuple(g) + row[len(g):] for g in given], AUTHOR_EVIDENCE)
    base = rows(("10.1/a", 1, "Ann Lee"), ("10.1/a", 2, "--"), (None, 1, "Cy Fox"))
    other = rows(("10.1/a", 5, "ANN LEE", "U"), ("10.1/a", 6, "Di Roe", "V", None, 9), ("10.1/a", 7, "di-roe", "W", None, 9),
                 ("10.1/b", 1, "Bo Chan", "X"), (None, 1, "Cy Fox", "Y"))
    want = {"enrich_registry": 5, "fuse_registry_vision": 5, "merge_hover": 6}
    for name, n in want.items():
        out = getattr(fusion, name)(base, other)
        got = {(r.doi, r.pos): (r.name, r.affiliation) for r in out.collect()}
        assert out.count() == n
        assert got["10.1/a", 1] == ("Ann Lee", "U") and got["10.1/b", 1] == ("Bo Chan", "X")
        assert out.where("doi IS NULL AND affiliation IS NULL").count() == 1
        assert ("10.1/a", 8) not in got or got["10.1/a", 8] == ("Di Roe", "V")
        plan = getattr(fusion, name)(base, other)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 1
