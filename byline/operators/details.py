"""Paper details, stage labels and library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.functions.text import strip
from byline.operators.ranking import rank_within

PART = 10000


def paper_detail(papers: DataFrame, paper_authors: DataFrame) -> DataFrame:
    """Papers with their authors nested in rank order.

    One row per paper and ``part``; a part holds at most 10,000 consecutive ranks, so
    a paper of any size is never gathered in one row. Ordinary papers have part 0 only.
    """
    author = F.struct(
        "rank", F.col("raw_name").alias("name"), F.col("raw_affiliation").alias("affiliation"),
        F.col("raw_affiliations").alias("affiliations"), "is_corresponding", "is_co_first", "matched_faculty_id")
    nested = (paper_authors.withColumn("part", F.floor((F.col("rank") - 1) / PART).cast("int"))
              .groupBy(F.col("paper_doi").alias("doi"), "part")
              .agg(F.array_sort(F.collect_list(author)).alias("authors")))
    return (papers.select("doi", "title", "journal", "status").join(nested, "doi", "left")
            .withColumn("part", F.coalesce("part", F.lit(0))))


def stage_labels(records: DataFrame) -> DataFrame:
    """Add ``stage`` and ``has_text`` to run records (doi, error, screenshot_status,
    ocr_failed, screenshot_path, image_path, status, text)."""
    def given(c):
        return F.length(F.coalesce(c, F.lit(""))) > 0
    stage = (F.when(given("error"), "error")
             .when(F.col("screenshot_status") == "BLOCKED_OR_FAILED", "screenshot_failed")
             .when(F.col("ocr_failed"), "ocr_failed")
             .when(given("screenshot_path") | given("image_path"), "captured")
             .when(F.col("status") == "metadata_ready", "metadata_only")
             .otherwise("failed"))
    return records.withColumn("stage", stage).withColumn(
        "has_text", F.length(F.coalesce("text", F.lit(""))) > 5)


def stage_summary(records: DataFrame) -> DataFrame:
    return stage_labels(records).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_text").alias("with_text"))


def department_stats(departments: DataFrame) -> DataFrame:
    return departments.agg(F.count(F.lit(1)).alias("total_departments"),
                           F.count_if(F.size("aliases") > 0).alias("with_aliases"),
                           F.count_if(F.size("keywords") > 0).alias("with_keywords"))


def staff_stats(staff: DataFrame) -> DataFrame:
    def filled(c):
        return F.count_if(F.length(F.coalesce(c, F.lit(""))) > 0)
    return staff.agg(F.count(F.lit(1)).alias("total_faculty"),
                     F.count_distinct("dept_id").alias("total_depts"),
                     filled("email").alias("with_email"), filled("position").alias("with_position"),
                     filled("research_area").alias("with_research_area"))


def department_index(staff: DataFrame) -> DataFrame:
    """(dept_id, staff): size of each department of the staff library."""
    return staff.groupBy("dept_id").agg(F.count(F.lit(1)).alias("staff"))


def department_members(staff: DataFrame) -> DataFrame:
    """(dept_id, place, employee_id): the staff of each department in library order, one row each."""
    return rank_within(staff.select("dept_id", "lib_order", "employee_id"), ["dept_id"], "lib_order", ["employee_id"], "place") \
        .select("dept_id", "place", "employee_id")


def staff_of(staff: DataFrame, dept_id: str) -> DataFrame:
    return staff.where(F.col("dept_id") == F.lower(strip(F.lit(dept_id))))
