"""Roster loading, maintenance and libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from byline.operators import details, keywords, roster
from byline.plans.catalog import views as V
from byline.plans.catalog.registry import query
from byline.sources import files


def _file_rows(t):
    key = F.col("o_orderkey")
    return t.orders.select(key.alias("row_index"), F.col("o_orderpriority").alias("name_zh"),
                           F.col("o_orderstatus").alias("department"),
                           F.when(key % 4 == 0, F.concat(F.lit("0"), key)).otherwise(" ").alias("employee_id"))


@query("""WITH r AS (SELECT o_orderkey AS row_index, o_orderpriority AS name_zh, o_orderstatus AS department,
  CASE WHEN o_orderkey % 4 = 0 THEN '0' || o_orderkey END AS eid,
  'gen_' || substr(md5(o_orderpriority || '|' || o_orderstatus), 1, 8) AS base FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY base, eid IS NULL ORDER BY row_index) - 1 AS k FROM r)
SELECT row_index, name_zh, department,
       CASE WHEN eid IS NOT NULL THEN eid WHEN k = 0 THEN base ELSE base || '_' || k END AS employee_id FROM n""")
def surrogate_ids(t):
    return roster.surrogate_ids(_file_rows(t))


@query("""WITH r AS (SELECT o_orderkey AS row_index, o_custkey AS eid, o_orderstatus = 'P' AS nameless FROM orders)
SELECT row_index, CAST(eid AS VARCHAR) AS employee_id, 'missing name' AS error FROM r WHERE nameless
UNION ALL SELECT row_index, CAST(eid AS VARCHAR), 'duplicate id in file' FROM (
  SELECT *, min(row_index) OVER (PARTITION BY eid) AS first FROM r) WHERE row_index > first""")
def roster_errors(t):
    rows = t.orders.select(F.col("o_orderkey").alias("row_index"), F.lit("x").alias("department"),
                           F.when(F.col("o_orderstatus") != "P", "Ann").alias("name_zh"),
                           F.col("o_custkey").cast("string").alias("employee_id"))
    return roster.check_roster(rows)


@query("""WITH s AS (SELECT DISTINCT unnest(string_split(p_name, '')) AS ch FROM part),
m AS (SELECT ch, ch || 'a' AS syl FROM s WHERE ch NOT IN (' ', 'z')),
p AS (SELECT p_partkey AS row_index, string_split(replace(p_name, ' ', ''), '') AS cs FROM part)
SELECT row_index, CASE WHEN list_contains(cs, 'z') THEN ''
  ELSE array_to_string(list_transform(cs[2:], lambda c: upper(c) || 'a'), ' ') || ' ' || upper(cs[1]) || 'a'
    || '|' || array_to_string(list_transform(cs[2:], lambda c: upper(c) || '.'), ' ') || ' ' || upper(cs[1]) || 'a' END
  AS variants FROM p""")
def name_variants(t):
    chars = t.part.select(F.explode(F.split("p_name", "")).alias("ch")).where("ch NOT IN ('', ' ', 'z')").distinct()
    syllables = chars.select("ch", F.concat("ch", F.lit("a")).alias("syllable"))
    rows = t.part.select(F.col("p_partkey").alias("row_index"),
                         F.replace("p_name", F.lit(" "), F.lit("")).alias("name_zh"))
    return roster.name_variants(rows, syllables).select("row_index", F.array_join("name_en_list", "|").alias("variants"))


@query(f"""WITH {V.FACULTY}, incoming AS (SELECT 'E' || c_custkey AS employee_id, c_name AS name_zh FROM customer)
SELECT employee_id, name_zh FROM incoming ANTI JOIN faculty USING (employee_id)""")
def roster_insert(t):
    return roster.insert_absent(V.faculty(t), _incoming(t))


def _incoming(t):
    return t.customer.select(F.concat(F.lit("E"), "c_custkey").alias("employee_id"), F.col("c_name").alias("name_zh"))


@query(f"""WITH {V.FACULTY}, incoming AS (SELECT 'E' || c_custkey AS employee_id FROM customer)
SELECT count(*) FILTER (f.employee_id IS NULL) AS added, count(f.employee_id) AS skipped
FROM incoming LEFT JOIN faculty f USING (employee_id)""")
def roster_load_counts(t):
    return roster.load_counts(V.faculty(t), _incoming(t))


def _changes(t):
    key = F.col("c_custkey")
    return t.customer.select(
        F.when(key % 5 == 0, "delete").when(key % 5 < 3, "update").otherwise("create").alias("op"),
        F.when(key % 5 < 3, key).otherwise(key + 1000000).alias("id"),
        F.concat(F.lit("E"), key % 700).alias("employee_id"),
        F.when(key % 11 != 0, F.concat(F.lit(" "), "c_name")).otherwise(" ").alias("name_zh"),
        F.concat(F.lit("a"), key, F.lit("; ，b/"), "c_mktsegment", F.lit("|")).alias("name_en_text"),
        F.nullif(F.concat(F.lit(""), F.when(key % 3 == 0, "Lab").otherwise("")), F.lit("")).alias("department"),
        F.lit(" ").alias("departments_text"))


CHANGES = f"""WITH {V.FACULTY}, changes AS (
  SELECT CASE WHEN c_custkey % 5 = 0 THEN 'delete' WHEN c_custkey % 5 < 3 THEN 'update' ELSE 'create' END AS op,
    CASE WHEN c_custkey % 5 < 3 THEN c_custkey ELSE c_custkey + 1000000 END AS id,
    'E' || (c_custkey % 700) AS employee_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name_zh,
    'a' || c_custkey || ',b,' || c_mktsegment AS names,
    CASE WHEN c_custkey % 3 = 0 THEN 'Lab' END AS department FROM customer),
merged AS (
  SELECT id, employee_id, name_zh, '' AS names, department FROM faculty
  ANTI JOIN (SELECT id FROM changes WHERE op <> 'create') USING (id)
  UNION ALL SELECT id, employee_id, name_zh, names, department FROM changes
  WHERE name_zh IS NOT NULL AND (op = 'create' OR (op = 'update' AND id IN (SELECT id FROM faculty))))"""


@query(f"{CHANGES} SELECT * FROM merged")
def roster_changes(t):
    return roster.apply_roster_changes(V.faculty(t), _changes(t)).select(
        "id", "employee_id", "name_zh", F.array_join("name_en_list", ",").alias("names"), "department")


@query(f"{CHANGES} SELECT employee_id, count(*) AS n FROM merged GROUP BY employee_id HAVING count(*) > 1")
def roster_conflicts(t):
    return roster.change_conflicts(V.faculty(t), _changes(t))


@query(f"""WITH {V.PAPER_AUTHORS}
SELECT paper_doi, rank, raw_name, CASE WHEN matched_faculty_id NOT IN (SELECT s_suppkey FROM supplier
       WHERE s_acctbal < 2000) THEN matched_faculty_id END AS matched_faculty_id FROM paper_authors""")
def detach_deleted(t):
    gone = t.supplier.where("s_acctbal < 2000").select(F.col("s_suppkey").alias("id"))
    authors = V.paper_authors(t).select("paper_doi", "rank", "raw_name", "matched_faculty_id")
    return roster.detach_deleted(authors, gone)


@query(f"""WITH {V.FACULTY} SELECT id, employee_id, name_zh, department FROM faculty
WHERE name_zh ILIKE '%FF _%' AND department ILIKE '%tion_1%' ORDER BY id DESC LIMIT 200""")
def roster_search(t):
    found = roster.search_roster(V.faculty(t), name="FF _", department=" tion_1")
    return roster.newest(found).select("id", "employee_id", "name_zh", "department")


def _departments(t):
    """Parts as department rows: the brand is the id, so later rows replace earlier ones."""
    return files.department_library(t.part.select(
        F.col("p_partkey").alias("row_index"), F.concat(F.lit(" "), "p_brand").alias("dept_id"),
        F.col("p_type").alias("dept_name_zh"), F.col("p_name").alias("dept_name_en"),
        F.when(F.col("p_size") > 10, F.concat("p_type", F.lit(" , "), "p_name", F.lit(",,"))).alias("aliases"),
        F.when(F.col("p_size") > 20, F.replace("p_name", F.lit(" "), F.lit(","))).alias("words")),
        {"keywords": "words"})


DEPARTMENTS = """lib AS (
  SELECT p_brand AS dept_id, max_by(p_type, p_partkey) AS name_zh, max_by(p_name, p_partkey) AS name_en,
         max_by(CASE WHEN p_size > 10 THEN lower(p_type || '|' || p_name) ELSE '' END, p_partkey) AS aliases,
         max_by(CASE WHEN p_size > 20 THEN replace(p_name, ' ', '|') ELSE '' END, p_partkey) AS keywords,
         min(p_partkey) AS lib_order FROM part GROUP BY p_brand)"""


@query(f"WITH {DEPARTMENTS} SELECT * FROM lib")
def department_library(t):
    return (_departments(t).withColumn("aliases", F.array_join("aliases", "|"))
            .withColumn("keywords", F.array_join("keywords", "|")))


@query(f"""WITH {DEPARTMENTS} SELECT count(*) AS total_departments, count(*) FILTER (aliases <> '') AS with_aliases,
count(*) FILTER (keywords <> '') AS with_keywords FROM lib""")
def department_stats(t):
    return details.department_stats(_departments(t))


def _staff(t):
    return files.staff_library(t.customer.select(
        F.col("c_custkey").alias("row_index"),
        F.when(F.col("c_custkey") % 13 != 0, F.concat("c_custkey", F.lit(" "))).otherwise("").alias("employee_id"),
        F.col("c_name").alias("name_zh"), F.col("c_mktsegment").alias("dept_id"),
        F.when(F.col("c_acctbal") > 0, "a@b.c").otherwise(" ").alias("email"),
        F.when(F.col("c_nationkey") > 5, "Lecturer").alias("position")))


STAFF = """staff AS (SELECT CAST(c_custkey AS VARCHAR) AS employee_id, c_name AS name_zh,
  lower(c_mktsegment) AS dept_id, CASE WHEN c_acctbal > 0 THEN 'a@b.c' END AS email,
  CASE WHEN c_nationkey > 5 THEN 'Lecturer' END AS position, c_custkey AS lib_order
  FROM customer WHERE c_custkey % 13 <> 0)"""


@query(f"WITH {STAFF} SELECT * FROM staff")
def staff_library(t):
    return _staff(t).drop("name_en", "research_area")


@query(f"""WITH {STAFF} SELECT count(*) AS total_faculty, count(DISTINCT dept_id) AS total_depts,
count(email) AS with_email, count(position) AS with_position, 0 AS with_research_area FROM staff""")
def staff_stats(t):
    return details.staff_stats(_staff(t))


@query(f"WITH {STAFF} SELECT dept_id, count(*) AS staff FROM staff GROUP BY dept_id")
def department_index(t):
    return details.department_index(_staff(t))


@query(f"""WITH {STAFF} SELECT dept_id, employee_id,
row_number() OVER (PARTITION BY dept_id ORDER BY lib_order, employee_id) AS place FROM staff""")
def department_members(t):
    return details.department_members(_staff(t))


@query(f"WITH {STAFF} SELECT employee_id, dept_id FROM staff WHERE dept_id = 'machinery'")
def staff_of_department(t):
    return details.staff_of(_staff(t), " MACHINERY ").select("employee_id", "dept_id")


@query(r"""WITH d AS (SELECT lower(p_type || ', ' || p_name || '; ' || p_brand || '/x') AS d FROM part),
s AS (SELECT trim(unnest(string_split_regex(d, '[,;/|]'))) AS s FROM d)
SELECT d AS keyword FROM d UNION SELECT s FROM s WHERE length(s) >= 3 UNION SELECT unnest(['west china', 'u'])""")
def school_keywords(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.lit(None).cast("array<string>").alias("departments"),
                         F.concat("p_type", F.lit(", "), "p_name", F.lit("; "), "p_brand", F.lit("/x")).alias("department"))
    return keywords.school_keywords(rows, "West China, ,U")
