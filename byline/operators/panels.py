"""Affiliations and contribution flags from author-information panels.

Panels are rows (doi, pos, name, text): the panel text shown for one author. All
work on a panel is local to its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.functions.text import (EMAIL, INSTITUTION_WORDS, ascii_punctuation, bind, contains_any,
                                   first_seen, initials_token, lines, name_parts, squeeze, squeezed_lines,
                                   strip, strip_accents)
from byline.session import spread_out

# Fixed values.
AFFILIATION_LINE_WORDS = INSTITUTION_WORDS + ["academy", "faculty", "state key laboratory",
                                              "key laboratory"]
BEST_LINE_WORDS = INSTITUTION_WORDS + ["affiliation", "affiliations"]
PANEL_HEADINGS = ["authors and affiliations", "author information", "corresponding authors",
                  "correspondence to", "contributions"]
SECTION_START = "authors and affiliations"
SECTION_ENDS = ["contributions", "corresponding authors", "additional information"]
NOTE_WORDS = ["corresponding", "equal contribution", "contributed equally"]
CORRESPONDING_WORDS = ["corresponding author", "correspondence", "email", "e-mail"]
CO_FIRST_WORDS = ["equal contribution", "contributed equally", "co-first", "co first"]


def _plain(c: Column) -> Column:
    return squeeze(F.coalesce(c, F.lit("")))


def _holds(c: Column, phrases: list[str]) -> Column:
    """``contains_any`` for a bound, non-null column: plain searches, cheaper than a pattern of many branches."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def _no_email(s: Column) -> Column:
    return ~(F.contains(s, F.lit("@")) & s.rlike(EMAIL))


# The tests of a line, cheap ones first: ``s`` is a bound, stripped line, so it may be mentioned often.

def _person(s: Column) -> Column:
    """Shape, length and digits of a name; institution words are not looked for."""
    return (F.length(s).between(4, 80) & s.rlike(r"^[A-Z][A-Za-z.'\-]+(?: [A-Z][A-Za-z.'\-]+){1,5}$") & ~s.rlike(r"[\p{Nd}\p{No}]"))


def _affiliation_line(s: Column) -> Column:
    return F.length(s).between(25, 340) & bind(F.lower(s), lambda low: (
        (_holds(low, AFFILIATION_LINE_WORDS) | (F.contains(s, F.lit(",")) & (F.length(s) >= 40)))
        & ~_holds(low, PANEL_HEADINGS) & _no_email(s)))


def _author_list_line(s: Column) -> Column:
    return F.length(s).between(6, 220) & bind(F.lower(s), lambda low: (
        (F.contains(s, F.lit(",")) | F.contains(s, F.lit("&")) | F.contains(low, F.lit(" and ")) | bind(squeeze(s), _person))
        & ~_holds(low, INSTITUTION_WORDS) & _no_email(s)))


def is_person_name(c: Column) -> Column:
    return bind(_plain(c), lambda s: _person(s) & ~contains_any(F.lower(s), INSTITUTION_WORDS))


def is_affiliation_line(c: Column) -> Column:
    return bind(strip(F.coalesce(c, F.lit(""))), _affiliation_line)


def is_author_list_line(c: Column) -> Column:
    return bind(strip(F.coalesce(c, F.lit(""))), _author_list_line)


def _comma_parts(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda p: F.regexp_replace(p, "^[ ,;\t]+|[ ,;\t]+$", ""))


def author_list(c: Column) -> Column:
    """Names of an author-list line: '&', 'and' and commas separate; marks removed."""
    s = _plain(c)
    parts = _comma_parts(F.regexp_replace(F.replace(s, F.lit("&"), F.lit(",")), r"(?iU)\band\b", ","))
    bare = F.transform(parts, lambda p: squeeze(F.regexp_replace(p, "[0-9*†‡¹²³]+", "")))
    names = F.filter(bare, lambda p: (F.length(p) >= 3) & F.contains(p, F.lit(" ")))
    return F.when(s == "", F.array().cast("array<string>")).when(is_person_name(s), F.array(s)).otherwise(names)


def affiliation_pairs(text: Column) -> Column:
    """ARRAY<STRUCT<affiliation, authors>> from consecutive panel lines.

    Inside the section, an affiliation line followed by an author-list line is a pair
    and both lines are used up. One fold over the lines: the state holds the place in
    the text (before, inside, after the section), the affiliation line that waits for
    its authors, and the pairs of lines so far. A line is tested only where the state asks
    for it, and the names are cut out after the fold.
    """
    none = F.lit(None).cast("string")
    zero = F.struct(F.lit(0).alias("place"), none.alias("open"),
                    F.array().cast("array<struct<affiliation:string,line:string>>").alias("out"))
    state = lambda place, waiting, out: F.struct(F.lit(place).alias("place"), waiting.alias("open"), out.alias("out"))

    def step(s, x):
        def tested(pair):
            item = F.struct(s["open"].alias("affiliation"), x.alias("line"))
            return F.when(pair, state(1, none, F.array_append(s["out"], item))).otherwise(
                state(1, F.when(_affiliation_line(x), x), s["out"]))
        started = F.contains(F.lower(x), F.lit(SECTION_START))
        stopped = bind(F.lower(x), lambda low: _holds(low, SECTION_ENDS))
        return (F.when((s["place"] == 2) | ((s["place"] == 1) & (x == "")), s)
                .when(s["place"] == 0, F.when(started, state(1, none, s["out"])).otherwise(s))
                .when(stopped, state(2, none, s["out"]))
                .otherwise(bind(s["open"].isNotNull() & _author_list_line(x), tested)))
    found = F.aggregate(squeezed_lines(text), zero, step, lambda s: s["out"])
    return F.transform(found, lambda p: F.struct(p["affiliation"], author_list(p["line"]).alias("authors")))


def correspondence_names(text: Column) -> Column:
    """Names in 'correspondence to A, B and C'."""
    found = squeeze(F.regexp_extract(F.coalesce(text, F.lit("")),
                                     r"(?idU)correspondence\s+to\s+(.{1,200}?)(?:\.|\n|\z)", 1))
    parts = _comma_parts(F.regexp_replace(F.replace(found, F.lit("&"), F.lit(",")), r"(?iU)\b(or|and)\b", ","))
    return F.filter(parts, lambda p: F.contains(p, F.lit(" ")) & (F.length(p) <= 80))


def equal_initials(text: Column) -> Column:
    """Initials such as 'a.b.' near the equal-contribution phrase."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    at = F.coalesce(F.nullif(F.position(F.lit("contributed equally"), low), F.lit(0)),
                    F.nullif(F.position(F.lit("equal contribution"), low), F.lit(0))) - 1
    begin = F.greatest(F.lit(0), at - 280)
    window = F.substring(t, begin + 1, at + 140 - begin)
    pattern = F.lit(r"(?U)\b([A-Z])\.\s*([A-Z])\.")
    pairs = F.zip_with(F.regexp_extract_all(window, pattern, F.lit(1)),
                       F.regexp_extract_all(window, pattern, F.lit(2)),
                       lambda a, b: F.lower(F.concat(a, F.lit("."), b, F.lit("."))))
    return F.coalesce(F.array_distinct(pairs), F.array().cast("array<string>"))


def names_match(a: Column, b: Column) -> Column:
    """Same last name and same first initial, over ``name_parts`` structs."""
    return F.coalesce((a["last"] == b["last"])
                      & (F.substring(a["first"], 1, 1) == F.substring(b["first"], 1, 1)), F.lit(False))


def affiliations_from_text(text: Column, max_lines: int | None = None) -> Column:
    """Distinct lines that look like affiliations (score >= 3), all or the first ``max_lines``."""
    def good(s):
        # an institution word scores 3, a comma and a usual length 1 each: without the word the score stays below 3
        return (F.length(s) >= 10) & bind(F.lower(s), lambda low: _holds(low, INSTITUTION_WORDS) & ~_holds(low, NOTE_WORDS) & _no_email(s))
    found = first_seen(F.filter(squeezed_lines(text), good))
    return found if max_lines is None else F.slice(found, 1, max_lines)


def best_line(text: Column) -> Column:
    """The first line with the best score (keyword 2, fifteen characters 1); '' if over 240."""
    rows = F.filter(F.transform(lines(text), strip), lambda x: F.length(x) > 0)
    worded = lambda x: bind(F.lower(x), lambda low: _holds(low, BEST_LINE_WORDS))
    scored = F.transform(rows, lambda x, i: F.struct(
        (-(F.when(worded(x), 2).otherwise(0) + F.when(F.length(x) >= 15, 1).otherwise(0))).alias("s"), i.alias("i"), x.alias("line")))
    return bind(F.array_min(scored)["line"], lambda best: F.when(F.length(best) <= 240, best).otherwise(""))


def extract_panel_affiliations(panels: DataFrame) -> DataFrame:
    """(doi, pos, name, affiliation, affiliations, is_co_first, text_corresponding).

    Panel pairs naming the author win over affiliation-like lines of the text. The
    text-derived corresponding flag is reported but is not evidence by itself.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    rows = (spread_out(panels).withColumn("_pairs", affiliation_pairs(text))
            .withColumn("_corr", correspondence_names(text))
            .withColumn("_init", equal_initials(text)))
    # Names of all pairs travel through one Arrow call as one string per row.
    joined = F.array_join(F.transform("_pairs", lambda p: F.array_join(p["authors"], "\t")), "\n")
    rows = (rows.withColumn("_names", F.transform(F.split(strip_accents(joined), "\n"), lambda g: F.split(g, "\t")))
            .withColumn("_cn", F.split(strip_accents(F.array_join("_corr", "\t")), "\t"))
            .withColumn("_me", name_parts(strip_accents(F.coalesce("name", F.lit(""))))))
    me = F.col("_me")
    mine = F.filter(F.transform(F.arrays_zip("_pairs", "_names"), lambda z: F.when(
        F.exists(z["_names"], lambda n: names_match(me, name_parts(n))), z["_pairs"]["affiliation"])),
        lambda a: a.isNotNull())
    mine = first_seen(mine)
    affs = F.when(F.size(mine) > 0, mine).otherwise(affiliations_from_text(text))

    def near(word):
        at = F.position(F.lit(word), low)
        begin = F.greatest(F.lit(0), at - 121)
        window = F.substring(low, begin + 1, at - 1 + 160 - begin)
        return (at > 0) & F.coalesce(F.contains(window, me["last"]), F.lit(False))
    close = F.lit(False)
    for word in CO_FIRST_WORDS:
        close = close | near(word)
    named = F.length(F.coalesce("name", F.lit(""))) > 0
    token = initials_token(me)
    co_first = (F.when(~named, contains_any(low, CO_FIRST_WORDS))
                .when(F.size("_init") > 0, F.coalesce(F.array_contains("_init", token), F.lit(False)))
                .otherwise(close))
    corresponding = F.when(named & (F.size("_corr") > 0),
                           F.exists("_cn", lambda n: names_match(me, name_parts(n)))) \
        .otherwise(contains_any(low, CORRESPONDING_WORDS))
    out = rows.withColumn("_affs", affs)
    return out.select(
        "doi", "pos", "name",
        ascii_punctuation(F.when(F.size("_affs") > 0, F.array_join("_affs", "; "))
                          .otherwise(F.coalesce(best_line(text), F.lit("")))).alias("affiliation"),
        F.transform("_affs", ascii_punctuation).alias("affiliations"),
        co_first.alias("is_co_first"), corresponding.alias("text_corresponding"))
