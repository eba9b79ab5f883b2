"""Attribution reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribution_report(papers: DataFrame, paper_authors: DataFrame, faculty: DataFrame) -> DataFrame:
    """Which paper was written by which person of which department: eight columns.

    Catalyst broadcasts the roster when its size allows and otherwise sorts and merges,
    splitting a person who holds a large share of the rows.
    """
    staff = faculty.select(F.col("id").alias("matched_faculty_id"), "name_zh", "employee_id", "department")
    return (paper_authors.select(F.col("paper_doi").alias("doi"), "rank", "matched_faculty_id")
            .where(F.col("matched_faculty_id").isNotNull())
            .join(staff, "matched_faculty_id")
            .join(papers.select("doi", "title", "journal", "publish_date"), "doi")
            .select("doi", "title", "journal", "publish_date", F.col("name_zh").alias("faculty_name"),
                    "employee_id", "department", F.col("rank").alias("author_rank")))


def report_counts(report: DataFrame) -> DataFrame:
    """One row: distinct papers, distinct people, most frequent department or N/A."""
    return report.agg(F.count_distinct("doi").alias("papers"), F.count_distinct("employee_id").alias("people"),
                      F.coalesce(F.mode("department", True), F.lit("N/A")).alias("top_department"))


def department_counts(report: DataFrame) -> DataFrame:
    """Report rows per department (author rows, not distinct papers)."""
    return (report.where(F.col("department").isNotNull())
            .groupBy("department").agg(F.count(F.lit(1)).alias("n")))


def top_staff(report: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` names with most rows; people of one name count together."""
    return (report.groupBy("faculty_name").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "faculty_name").limit(k))


def only_departments(report: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """Report rows of the chosen departments; all that have one by default."""
    if departments is None:
        return report.where(F.col("department").isNotNull())
    return report.where(F.col("department").isin(departments))


def overview(papers: DataFrame, paper_authors: DataFrame, faculty: DataFrame) -> DataFrame:
    """One row of platform counts."""
    p = papers.agg(F.count(F.lit(1)).alias("papers"),
                   F.count_if(F.col("status") == "COMPLETED").alias("completed"),
                   F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"))
    authors = paper_authors.agg(F.count(F.lit(1)))
    staff = faculty.agg(F.count(F.lit(1)))
    placed = faculty.agg(F.count_if(F.col("department").isNotNull()))
    return p.select("papers", authors.scalar().alias("author_rows"), "completed", "needs_review",
                    staff.scalar().alias("staff"), placed.scalar().alias("staff_with_department"))


def recent_papers(papers: DataFrame, k: int = 5) -> DataFrame:
    return papers.orderBy(F.col("created_at").desc(), "doi").limit(k)


def authors_in_order(paper_authors: DataFrame) -> DataFrame:
    return paper_authors.orderBy("paper_doi", "rank")


def export_report(report: DataFrame, path: str) -> None:
    """Write the report as CSV files with a header each (runs a job)."""
    report.write.mode("overwrite").option("header", True).csv(path)
