"""Reports, overviews and paper details."""

from __future__ import annotations

from pyspark.sql import functions as F

from byline.operators import admission, decisions, details, reports
from byline.plans.catalog import views as V
from byline.plans.catalog.registry import Tables, query


def _report(t: Tables):
    return reports.attribution_report(V.papers(t), V.paper_authors(t), V.faculty(t))


@query(f"WITH {V.REPORT} SELECT * FROM report")
def attribution_report(t):
    return _report(t)


@query(f"""WITH {V.REPORT}
SELECT count(DISTINCT doi) AS papers, count(DISTINCT employee_id) AS people,
       coalesce((SELECT department FROM report WHERE department IS NOT NULL
                 GROUP BY department ORDER BY count(*) DESC, department LIMIT 1), 'N/A') AS top_department
FROM report""")
def report_counts(t):
    return reports.report_counts(_report(t))


@query(f"""WITH {V.REPORT}
SELECT department, count(*) AS n FROM report WHERE department IS NOT NULL GROUP BY department""")
def report_departments(t):
    return reports.department_counts(_report(t))


@query(f"""WITH {V.REPORT}
SELECT faculty_name, count(*) AS n FROM report GROUP BY faculty_name ORDER BY n DESC, faculty_name LIMIT 5""")
def report_top_staff(t):
    return reports.top_staff(_report(t))


@query(f"WITH {V.REPORT} SELECT * FROM report WHERE department IN ('NATION_3', 'NATION_7')")
def report_of_departments(t):
    return reports.only_departments(_report(t), ["NATION_3", "NATION_7"])


@query(f"""WITH {V.PAPERS}, {V.PAPER_AUTHORS}, {V.FACULTY}
SELECT count(*) AS papers, (SELECT count(*) FROM paper_authors) AS author_rows,
       count(*) FILTER (status = 'COMPLETED') AS completed,
       count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review,
       (SELECT count(*) FROM faculty) AS staff,
       (SELECT count(department) FROM faculty) AS staff_with_department
FROM papers""")
def overview(t):
    return reports.overview(V.papers(t), V.paper_authors(t), V.faculty(t))


@query(f"""WITH {V.PAPERS}
SELECT doi, title, status, strftime(created_at, '%Y-%m-%d') AS created
FROM papers ORDER BY created_at DESC, doi LIMIT 5""")
def recent_papers(t):
    return reports.recent_papers(V.papers(t)).select(
        "doi", "title", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(f"""WITH {V.NUMBERED_LINEITEM}
SELECT '10.1/' || l_orderkey AS paper_doi, pos AS rank, 'Part ' || l_partkey AS raw_name FROM nl""")
def authors_in_order(t):
    ranked = V.numbered_lineitem(t).select(V.doi("l_orderkey").alias("paper_doi"), F.col("pos").alias("rank"),
                                           F.concat(F.lit("Part "), "l_partkey").alias("raw_name"))
    return reports.authors_in_order(ranked)


@query(f"""WITH {V.PAPERS}, {V.PAPER_AUTHORS}, nested AS (
  SELECT paper_doi AS doi, count(*) AS n,
         string_agg(rank || ':' || raw_name, '|' ORDER BY rank, raw_name) AS authors
  FROM paper_authors GROUP BY paper_doi)
SELECT doi, title, journal, status, 0 AS part, coalesce(n, 0) AS n, coalesce(authors, '') AS authors
FROM papers LEFT JOIN nested USING (doi)""")
def paper_detail(t):
    full = details.paper_detail(V.papers(t), V.paper_authors(t))
    names = F.transform("authors", lambda a: F.concat(a["rank"].cast("string"), F.lit(":"), a["name"]))
    return full.select("doi", "title", "journal", "status", "part",
                       F.coalesce(F.size("authors"), F.lit(0)).alias("n"),
                       F.coalesce(F.array_join(names, "|"), F.lit("")).alias("authors"))


@query(f"""WITH {V.PAPERS}, {V.PAPER_AUTHORS}, counts AS (
  SELECT paper_doi AS doi, count(matched_faculty_id) AS matched_authors, count(*) AS total_authors
  FROM paper_authors GROUP BY paper_doi)
SELECT doi, title, status, coalesce(matched_authors, 0) AS matched_authors,
       coalesce(total_authors, 0) AS total_authors FROM papers LEFT JOIN counts USING (doi)""")
def cached_records(t):
    return admission.cached_records(V.papers(t), V.paper_authors(t))


@query(f"""WITH {V.PAPERS}, {V.PAPER_AUTHORS}
SELECT paper_doi AS doi, rank, raw_name, raw_affiliation, is_corresponding, is_co_first, matched_faculty_id
FROM paper_authors WHERE paper_doi IN (SELECT doi FROM papers)""")
def cached_authors(t):
    return admission.cached_authors(V.papers(t), V.paper_authors(t))


@query(f"""WITH {V.PAPERS}, decided AS (
  SELECT '10.1/' || l_orderkey AS doi,
         CASE WHEN l_returnflag = 'A' THEN 'COMPLETED'
              WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'NEEDS_REVIEW'
              WHEN l_linestatus = 'F' THEN 'SKIPPED' END AS decision
  FROM lineitem), counts AS (
  SELECT p.doi, count(decision) AS saved, count(*) FILTER (decision = 'COMPLETED') AS matched,
         count(*) FILTER (decision = 'NEEDS_REVIEW') AS needs_review,
         count(*) FILTER (decision = 'SKIPPED') AS skipped, count(d.doi) AS total
  FROM papers p LEFT JOIN decided d USING (doi) GROUP BY p.doi)
SELECT *, CASE WHEN saved = 0 THEN 'SKIPPED' WHEN needs_review > 0 THEN 'NEEDS_REVIEW'
               WHEN matched > 0 THEN 'COMPLETED' WHEN skipped = saved THEN 'SKIPPED' ELSE 'COMPLETED' END AS status
FROM counts""")
def paper_statuses(t):
    decision = (F.when(F.col("l_returnflag") == "A", "COMPLETED")
                .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "NEEDS_REVIEW")
                .when(F.col("l_linestatus") == "F", "SKIPPED"))
    decided = t.lineitem.select(V.doi("l_orderkey").alias("doi"), decision.alias("decision"),
                                F.lit(True).alias("roster_loaded"))
    return decisions.paper_statuses(decided, V.papers(t))


@query("""WITH r AS (
  SELECT CASE WHEN event_type = 'error' THEN 'error'
              WHEN value < 5 THEN 'screenshot_failed'
              WHEN event_type = 'click' AND value > 80 THEN 'ocr_failed'
              WHEN event_type IN ('click', 'view') THEN 'captured'
              WHEN user_id % 2 = 0 THEN 'metadata_only' ELSE 'failed' END AS stage,
         length(props) > 8 AS has_text FROM events)
SELECT stage, count(*) AS n, count(*) FILTER (has_text) AS with_text FROM r GROUP BY stage""")
def stage_summary(t):
    kind = F.col("event_type")
    records = t.events.select(
        F.when(kind == "error", "failed").alias("error"),
        F.when(F.col("value") < 5, "BLOCKED_OR_FAILED").alias("screenshot_status"),
        ((kind == "click") & (F.col("value") > 80)).alias("ocr_failed"),
        F.when(kind == "click", "a.png").alias("screenshot_path"), F.when(kind == "view", "b.png").alias("image_path"),
        F.when(F.col("user_id") % 2 == 0, "metadata_ready").alias("status"),
        F.substring("props", 4, 1000).alias("text"))
    return details.stage_summary(records)
