"""Roster loading and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.functions.text import bind, strip
from byline.operators.ranking import rank_within

# Fixed values.
LIST_SEPARATORS = r"[\n,;，；\\|/]+"
PAGE_SIZE = 200


def split_list_text(c: Column) -> Column:
    """A free-text list field as an array; NULL when blank."""
    parts = F.filter(F.transform(F.split(strip(c), LIST_SEPARATORS), strip), lambda p: F.length(p) > 0)
    return F.when(F.size(parts) > 0, parts)


def surrogate_ids(rows: DataFrame) -> DataFrame:
    """Fill blank ``employee_id`` with gen_ + md5 prefix of name and department.

    ``rows``: (row_index, name_zh, department, employee_id). Repeats get _1, _2, ... in
    file order, skipping suffixes that explicit ids already use.
    """
    eid = strip(F.coalesce("employee_id", F.lit("")))
    rows = (rows.withColumn("employee_id", F.when((eid != "") & (F.lower(eid) != "nan"), eid))
            .withColumn("_base", F.concat(F.lit("gen_"), F.substring(
                F.md5(F.concat_ws("|", "name_zh", "department").cast("binary")), 1, 8))))
    blank = rank_within(rows.where(F.col("employee_id").isNull()), ["_base"], "row_index", name="_rank")
    # Explicit ids of the generated form: the k-th free suffix skips e when e - (its index) <= k.
    shape = r"^(gen_[0-9a-f]{8})(?:_([1-9][0-9]*))?$"
    taken = (rows.where(F.col("employee_id").rlike(shape))
             .select(F.regexp_extract("employee_id", shape, 1).alias("_base"),
                     F.coalesce(F.regexp_extract("employee_id", shape, 2).try_cast("int"), F.lit(0)).alias("_e"))
             .distinct())
    taken = (rank_within(taken, ["_base"], "_e", name="_i")
             .select("_base", (F.col("_e") - F.col("_i") + 1).alias("_gap")))
    skipped = (blank.select("_base", "row_index", "_rank").join(taken, "_base")
               .where(F.col("_gap") <= F.col("_rank") - 1)
               .groupBy("_base", "row_index").agg(F.count(F.lit(1)).alias("_skip")))
    suffix = F.col("_rank") - 1 + F.coalesce("_skip", F.lit(0))
    made = (blank.join(skipped, ["_base", "row_index"], "left")
            .withColumn("employee_id", F.when(suffix == 0, F.col("_base")).otherwise(
                F.concat("_base", F.lit("_"), suffix.cast("string"))))
            .drop("_rank", "_skip"))
    return rows.where(F.col("employee_id").isNotNull()).unionByName(made).drop("_base")


def name_variants(rows: DataFrame, syllables: DataFrame) -> DataFrame:
    """Add ``name_en_list``: 'Given Family' and 'G. G. Family'.

    ``syllables``: (ch, syllable). The first syllable is the family name. Names with a
    character outside the table, or of one syllable, get an empty list. A name is spelled
    where it stands: the table is one array by code point, which has at most as many
    places as Unicode, however long the roster is.
    """
    table = _by_code_point(syllables)

    def spelled(s):
        given = F.slice(s, F.lit(2), F.size(s))
        initials = F.transform(given, lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lit(".")))
        return F.when((F.size(s) > 1) & ~F.exists(s, lambda x: x.isNull()), F.array(
            F.concat_ws(" ", F.array_join(given, " "), F.get(s, F.lit(0))), F.concat_ws(" ", F.array_join(initials, " "), F.get(s, F.lit(0)))))
    chars = F.regexp_extract_all("name_zh", F.lit("(?s)."), F.lit(0))
    variants = bind(F.transform(chars, lambda ch: F.substr(F.nullif(F.get(table, F.ascii(ch)), F.lit("")), F.lit(2))), spelled)
    return rows.withColumn("name_en_list", F.coalesce(variants, F.array().cast("array<string>")))


def _by_code_point(syllables: DataFrame) -> Column:
    """The array whose place c holds '=' and the capitalised syllable, the least of several, of the character of code point c, or ''.

    One value in the plan (runs a job): expressions over arrays take no subquery.
    """
    # A least string is found by sorting; repeated rows are counted, that is hashed, before.
    pairs = (syllables.where((F.char_length("ch") == 1) & F.col("syllable").isNotNull()).groupBy("ch", "syllable")
             .agg(F.count(F.lit(1)).alias("n")).where("n > 0"))
    known = (pairs.groupBy(F.ascii("ch").alias("c")).agg(F.initcap(F.min("syllable")).alias("s"))).collect()
    table = [""] * (max((r.c for r in known), default=0) + 1)
    for r in known:
        table[r.c] = "=" + r.s
    return F.split(F.lit("\u0001".join(table)), "\u0001")


def check_roster(rows: DataFrame) -> DataFrame:
    """(row_index, employee_id, error) of rows that cannot be loaded."""
    nameless = rows.where(strip(F.coalesce("name_zh", F.lit(""))) == "").select(
        "row_index", "employee_id", F.lit("missing name").alias("error"))
    repeated = (rows.where(F.length(strip(F.coalesce("employee_id", F.lit("")))) > 0)
                .withColumn("employee_id", strip(F.col("employee_id"))))
    first = repeated.groupBy("employee_id").agg(F.min("row_index").alias("_first"))
    doubles = (repeated.join(first, "employee_id").where("row_index > _first")
               .select("row_index", "employee_id", F.lit("duplicate id in file").alias("error")))
    return nameless.unionByName(doubles)


def load_roster(rows: DataFrame, syllables: DataFrame | None = None) -> DataFrame:
    """File rows (row_index, name_zh, department, employee_id) as loadable roster rows.

    Rows reported by ``check_roster`` are left out.
    """
    good = (rows.join(check_roster(rows).select("row_index").distinct(), "row_index", "left_anti")
            .withColumn("name_zh", strip("name_zh")).withColumn("department", strip("department")))
    named = surrogate_ids(good)
    if syllables is None:
        return named.withColumn("name_en_list", F.array().cast("array<string>"))
    return name_variants(named, syllables)


def insert_absent(faculty: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose employee_id the roster does not have."""
    return incoming.join(faculty.select("employee_id"), "employee_id", "left_anti")


def load_counts(faculty: DataFrame, incoming: DataFrame) -> DataFrame:
    """(added, skipped) of loading ``incoming``."""
    known = faculty.select("employee_id").where("employee_id IS NOT NULL").distinct() \
        .withColumn("_known", F.lit(True))
    return incoming.join(known, "employee_id", "left").agg(
        F.count_if(F.col("_known").isNull()).alias("added"),
        F.count_if(F.col("_known")).alias("skipped"))


def assign_ids(incoming: DataFrame, first_id: int) -> DataFrame:
    """Number new roster rows in file order from ``first_id``."""
    keyed = incoming.withColumn("_all", F.lit(0))
    return (rank_within(keyed, ["_all"], "row_index", name="_r")
            .withColumn("id", (F.col("_r") + first_id - 1).cast("bigint")).drop("_all", "_r"))


def change_conflicts(faculty: DataFrame, changes: DataFrame) -> DataFrame:
    """(employee_id, n): ids that would belong to several rows after the changes."""
    return (_merged(faculty, changes).where(F.col("employee_id").isNotNull())
            .groupBy("employee_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def _merged(faculty: DataFrame, changes: DataFrame) -> DataFrame:
    kept = faculty.join(changes.where(F.col("op").isin("update", "delete")).select("id"), "id", "left_anti")
    updates = changes.where("op = 'update'").join(faculty.select("id"), "id", "left_semi")
    fresh = changes.where("op = 'create'").unionByName(updates)
    text = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return kept.unionByName(fresh.select(
        "id", text("employee_id").alias("employee_id"), text("name_zh").alias("name_zh"),
        split_list_text(F.col("name_en_text")).alias("name_en_list"), text("department").alias("department"),
        split_list_text(F.col("departments_text")).alias("departments")).where("name_zh IS NOT NULL"))


def apply_roster_changes(faculty: DataFrame, changes: DataFrame) -> DataFrame:
    """The roster after a change set (op, id, employee_id, name_zh, name_en_text,
    department, departments_text); list fields are free text.

    Check ``change_conflicts`` first. Updates of rows that do not exist are ignored,
    and so are creates and updates without a name.
    """
    return _merged(faculty, changes)


def detach_deleted(paper_authors: DataFrame, deleted: DataFrame) -> DataFrame:
    """Paper authors with matches to deleted roster rows removed."""
    gone = deleted.select(F.col("id").alias("matched_faculty_id")).distinct().withColumn("_gone", F.lit(True))
    return (paper_authors.join(gone, "matched_faculty_id", "left")
            .withColumn("matched_faculty_id", F.when(F.col("_gone").isNull(), F.col("matched_faculty_id")))
            .select(*paper_authors.columns))


def search_roster(faculty: DataFrame, name: str = "", employee_id: str = "", department: str = "") -> DataFrame:
    """Roster rows by name part, exact id and department part.

    The parts are LIKE patterns: % and _ are wildcards, letter case is ignored.
    """
    found = faculty
    if name.strip():
        found = found.where(F.col("name_zh").ilike(f"%{name.strip()}%"))
    if employee_id.strip():
        found = found.where(F.col("employee_id") == employee_id.strip())
    if department.strip():
        found = found.where(F.col("department").ilike(f"%{department.strip()}%"))
    return found


def newest(faculty: DataFrame, limit: int = PAGE_SIZE) -> DataFrame:
    return faculty.orderBy(F.col("id").desc()).limit(limit)
