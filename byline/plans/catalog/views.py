"""Library tables derived from the driver tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.plans.catalog.registry import Tables

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
              "l_discount", "l_tax"]


def doi(column: str):
    return F.concat(F.lit("10.1/"), F.col(column).cast("string"))


def papers(t: Tables) -> DataFrame:
    return t.orders.select(
        doi("o_orderkey").alias("doi"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.col("o_orderpriority").alias("journal"), F.year("o_orderdate").cast("string").alias("publish_date"),
        F.lit(None).cast("string").alias("pdf_path"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "NEEDS_REVIEW")
        .otherwise("PENDING").alias("status"), F.col("o_orderdate").alias("created_at"))


PAPERS = """papers AS (
  SELECT '10.1/' || o_orderkey AS doi, 'Order ' || o_orderkey AS title, o_orderpriority AS journal,
         CAST(year(o_orderdate) AS VARCHAR) AS publish_date,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'NEEDS_REVIEW' ELSE 'PENDING' END AS status,
         o_orderdate AS created_at
  FROM orders)"""


def paper_authors(t: Tables) -> DataFrame:
    return t.lineitem.select(
        doi("l_orderkey").alias("paper_doi"), F.col("l_linenumber").alias("rank"),
        F.concat(F.lit("Part "), "l_partkey").alias("raw_name"),
        F.concat(F.lit("Unit "), "l_returnflag").alias("raw_affiliation"),
        F.array(F.concat(F.lit("Unit "), "l_returnflag")).alias("raw_affiliations"),
        (F.col("l_returnflag") == "R").alias("is_corresponding"),
        ((F.col("l_linenumber") <= 2) & (F.col("l_linestatus") == "F")).alias("is_co_first"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("matched_faculty_id"))


PAPER_AUTHORS = """paper_authors AS (
  SELECT '10.1/' || l_orderkey AS paper_doi, l_linenumber AS rank, 'Part ' || l_partkey AS raw_name,
         'Unit ' || l_returnflag AS raw_affiliation, l_returnflag = 'R' AS is_corresponding,
         l_linenumber <= 2 AND l_linestatus = 'F' AS is_co_first,
         CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS matched_faculty_id
  FROM lineitem)"""


def faculty(t: Tables) -> DataFrame:
    """Suppliers as staff; the tenth of the names repeats, every ninth has no department."""
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("E"), "s_suppkey").alias("employee_id"),
        F.concat(F.lit("Staff "), F.col("s_suppkey") % 90).alias("name_zh"),
        F.array().cast("array<string>").alias("name_en_list"),
        F.when(F.col("s_suppkey") % 9 != 0, F.col("n_name")).alias("department"),
        F.array().cast("array<string>").alias("departments"))


FACULTY = """faculty AS (
  SELECT s_suppkey AS id, 'E' || s_suppkey AS employee_id, 'Staff ' || (s_suppkey % 90) AS name_zh,
         CASE WHEN s_suppkey % 9 <> 0 THEN n_name END AS department
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

REPORT = f"""{PAPERS}, {PAPER_AUTHORS}, {FACULTY}, report AS (
  SELECT p.doi, p.title, p.journal, p.publish_date, f.name_zh AS faculty_name, f.employee_id,
         f.department, a.rank AS author_rank
  FROM papers p JOIN paper_authors a ON p.doi = a.paper_doi JOIN faculty f ON a.matched_faculty_id = f.id)"""


def document_lines(t: Tables) -> DataFrame:
    """(doi, pos, line): the lines of every document, from 1."""
    return (t.documents.select(F.col("doc_id").cast("string").alias("doi"),
                               F.posexplode(F.split("text", "\n")).alias("i", "line"))
            .select("doi", (F.col("i") + 1).alias("pos"), "line"))


DOCUMENT_LINES = r"""document_lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS doi, i AS pos, ls[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
       unnest(range(1, len(ls) + 1)) AS u(i))"""


def benchmark_lines(t: Tables) -> DataFrame:
    return (t.benchmark.select("item_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
            .select("item_id", (F.col("i") + 1).alias("pos"), "line"))


BENCHMARK_LINES = r"""benchmark_lines AS (
  SELECT item_id, i AS pos, ls[i] AS line
  FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark),
       unnest(range(1, len(ls) + 1)) AS u(i))"""


def numbered_lineitem(t: Tables) -> DataFrame:
    """lineitem with ``pos``, its row number within the order."""
    from byline.operators.ranking import rank_within
    return rank_within(t.lineitem, ["l_orderkey"], "l_linenumber", LINE_ORDER[1:], name="pos")


NUMBERED_LINEITEM = f"""nl AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS pos
  FROM lineitem)"""
