"""What large tables cost is seen in the plans: no step twice, no shuffle that is not needed."""

import random

from pyspark.sql import functions as F

from byline.functions import text as T
from byline.operators import memory, panels, roster
from byline.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def random_texts(spark, letters, n=3000, most=14):
    draw = random.Random(5)
    return spark.createDataFrame([("".join(draw.choice(letters) for _ in range(draw.randint(0, most))),) for _ in range(n)] + [(None,)], "t STRING")


def test_blanks_as_patterns_say(spark):
    t = F.col("t")
    body = F.regexp_replace(t, rf"(?:{T.LINE_BREAK})\z", "")
    cut = F.when(F.length(t) > 0, F.split(body, T.LINE_BREAK)).otherwise(F.array().cast("array<string>"))
    slow = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    for letters in ("ab  \n", T.BLANKS + "ab\x1c\x1d\x1e\x1f᠎​﻿é中𝒳", "a \t\r\n"):
        rows = random_texts(spark, letters).select(
            (T.squeeze(t) == slow(t)).alias("squeeze"), T.strip(t).eqNullSafe(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).alias("strip"),
            T.lines(t).eqNullSafe(cut).alias("lines"), T.squeezed_lines(t).eqNullSafe(F.transform(cut, slow)).alias("both"))
        assert rows.where("NOT (squeeze AND strip AND lines AND both)").count() == 0


def test_first_seen_keeps_first_spellings(spark):
    def first(values):
        kept = {}
        for v in values:
            kept.setdefault(v.lower(), v)
        return list(kept.values())
    draw = random.Random(3)
    lists = [[draw.choice(["a", "A", "b", "B", "É", "é", ""]) for _ in range(draw.randint(0, 6))] for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in lists], "v array<string>").select("v", T.first_seen(F.col("v")).alias("got")).collect()
    assert all(r.got == first(r.v) for r in rows)


def test_panel_pairs_folds_a_text_once(spark):
    assert plan(QUERIES["panel_pairs"](spark, FOLDER)).count("aggregate(") == 1


def test_affiliation_lines_are_not_compared_pairwise(spark):
    found = plan(spark.range(1).select(panels.affiliations_from_text(F.col("id").cast("string"))))
    assert "exists(" not in found and "aggregate(" not in found


def test_line_tests_with_all_their_parts(spark):
    lines = ["Ann Lee", "Ann Lee, School of Law", "Dept. of Law, Long Street, Town, Land 12345 xx", "Law Faculty of a Town by the sea",
             "contributions of a university in a long line", "A University of some town, mail x@y.org here", "x & y z", "Bo and Al", "Bo\tand  Al", "", None,
             "plain words that say nothing at all", "Ann Lee 2", "ann lee"]
    rows = spark.createDataFrame([(x,) for x in lines], "x STRING").select(
        panels.is_person_name(F.col("x")).alias("p"), panels.is_affiliation_line(F.col("x")).alias("a"), panels.is_author_list_line(F.col("x")).alias("n")).collect()
    assert [i for i, r in enumerate(rows) if r.p] == [0]
    assert [i for i, r in enumerate(rows) if r.a] == [2, 3]
    assert [i for i, r in enumerate(rows) if r.n] == [0, 2, 6, 7]


def test_token_sets_are_made_once(spark):
    for name in ("similar_cases", "memory_signals"):
        found = plan(QUERIES[name](spark, FOLDER))
        assert "regexp_extract_all" not in found and "array_intersect" not in found, name


def test_similar_cases_against_all_pairs(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    sets = [[draw.choice(words) for _ in range(draw.randint(0, 9))] for _ in range(80)] + [[f"z{i}" for i in range(300)] + words]
    ask = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(sets)], "doi STRING, tokens array<string>")
    mem = spark.createDataFrame([(i, v) for i, v in enumerate(sets[:40])], "id LONG, layout_fingerprint array<string>")
    want = set()
    for i, a in enumerate(map(set, sets)):
        near = sorted((-len(a & b) / len(a | b), j) for j, b in enumerate(map(set, sets[:40])) if a & b and len(a & b) / len(a | b) >= 0.15)
        want |= {(f"d{i}", k + 1, j, round(-s, 9)) for k, (s, j) in enumerate(near[:3])}
    assert {(r.doi, r.place, r.id, round(r.score, 9)) for r in memory.similar_cases(ask, mem).collect()} == want


def test_names_are_spelled_where_they_stand(spark):
    table = spark.createDataFrame([("李", "li"), ("李", "zi"), ("明", "ming"), ("𠀀", "he"), ("xy", "no"), ("空", None), ("无", "")], "ch STRING, syllable STRING")
    rows = spark.createDataFrame([(1, "李明"), (2, "李"), (3, "李x"), (4, "明𠀀李"), (5, None), (6, "李空"), (7, "明" * 1200), (8, ""), (8, "李李"), (9, "明无")],
                                 "row_index LONG, name_zh STRING")
    out = roster.name_variants(rows, table)
    assert "Join" not in plan(out) and "Aggregate" not in plan(out)
    got = [(r.row_index, r.name_en_list) for r in out.collect()]
    assert got[0] == (1, ["Ming Li", "M. Li"]) and got[3] == (4, ["He Li Ming", "H. L. Ming"])
    assert [v for i, v in got if i in (2, 3, 5, 6)] == [[]] * 4 and [v for i, v in got if i == 8] == [[], ["Li Li", "L. Li"]]
    assert dict(got)[9] == [" Ming", ". Ming"]  # an empty syllable is known
    assert dict(got)[7][0] == " ".join(["Ming"] * 1200)
    assert [r.name_en_list for r in roster.name_variants(rows, table.limit(0)).collect()] == [[]] * 10
