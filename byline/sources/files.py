"""Readers for rosters, DOI lists, libraries, sidecars and stored tables."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from byline import schemas
from byline.functions.text import lines, strip
from byline.session import cut_lineage

DELIMITERS = [",", ";", "\t", "|"]


class MissingColumn(ValueError):
    """A required column is not in the file's header."""


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return first[0].value.lstrip("﻿") if first else ""


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the header line into most parts (reads one line)."""
    head = _header(spark, path)
    return max(DELIMITERS, key=head.count)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of file names and of lines within a file.

    Spark deals files to tasks by size and by the cores it has at the time, so the rows are stored once, with the file and
    split they came from, before they are numbered: later scans see the same numbers. A task numbers the
    rows of a split in their order; only the names, starts and sizes of splits are gathered, not rows.
    """
    stored = cut_lineage(df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at")))
    splits = stored.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    before, offsets = 0, []
    for s in sorted(splits, key=lambda s: (s["_file"], s["_start"])):
        offsets.append((s["_file"], s["_start"], before - s["_first"]))
        before += s["_n"]
    places = df.sparkSession.createDataFrame(offsets, "_file string, _start long, _offset long")
    return (stored.join(places, ["_file", "_start"]).withColumn(name, F.col("_at") + F.col("_offset"))
            .drop("_file", "_start", "_at", "_offset"))


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = False) -> DataFrame:
    """A delimited or Excel file with all columns as text, plus ``row_index`` in file order.

    ``multi_line`` reads quoted line breaks as part of a cell (one task per file then). A byte-order mark before the first header is removed. Only the header line reaches
    the driver.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        return read_excel(spark, path)
    sep = delimiter or sniff_delimiter(spark, path)
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line) \
        .option("quote", '"').option("escape", '"').csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return _numbered(df, "row_index").toDF(*names, "row_index")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Excel sheets through pandas inside tasks, one workbook per task.

    A workbook holds at most 1,048,576 rows, which bounds a task. Needs a pandas Excel
    engine on the executors.
    """
    def cells(batches):
        import pandas as pd
        for batch in batches:
            for content in batch["content"]:
                sheet = pd.read_excel(io.BytesIO(content), dtype=str)
                yield pd.DataFrame({
                    "row_index": range(len(sheet)),
                    "cells": [{str(k): v for k, v in row.items() if isinstance(v, str)}
                              for row in sheet.to_dict("records")]})
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(
        cells, "row_index BIGINT, cells MAP<STRING,STRING>")
    names = [r.k for r in rows.select(F.explode(F.map_keys("cells")).alias("k")).distinct().collect()]
    return rows.select("row_index", *[F.col("cells")[n].alias(n) for n in sorted(names)])


def _require(df: DataFrame, columns: list[str]) -> None:
    for column in columns:
        if column not in df.columns:
            raise MissingColumn(f"Missing required column '{column}'")


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def read_roster(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = False) -> DataFrame:
    """(row_index, name_zh, department, employee_id) from Name, Department and ID."""
    df = read_table(spark, path, delimiter, multi_line)
    _require(df, ["Name", "Department"])
    return df.select("row_index", strip(F.col("Name")).alias("name_zh"),
                     strip(F.col("Department")).alias("department"),
                     strip(_optional(df, "ID")).alias("employee_id"))


def doi_table(df: DataFrame) -> DataFrame:
    """(input_pos, doi) from the column named 'doi' in any case; blanks dropped."""
    column = next((c for c in df.columns if c.lower() == "doi"), None)
    if column is None:
        raise MissingColumn("Missing required column 'DOI'")
    return (df.select(F.col("row_index").alias("input_pos"), F.trim(F.col(column).cast("string")).alias("doi"))
            .where(F.length("doi") > 0))


def read_doi_table(spark: SparkSession, path: str) -> DataFrame:
    return doi_table(read_table(spark, path))


def read_doi_text(spark: SparkSession, path: str) -> DataFrame:
    """(input_pos, doi) from lines; blank lines and # comments dropped."""
    lines = spark.read.text(path)
    return (_numbered(lines, "input_pos")
            .select("input_pos", strip(F.col("value")).alias("doi"))
            .where((F.length("doi") > 0) & ~F.startswith("doi", F.lit("#"))))


def _word_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda w: F.lower(strip(w))),
                    lambda w: F.length(w) > 0)


def department_library(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(dept_id, name_zh, name_en, aliases, keywords, lib_order) from library rows.

    ``columns`` maps standard names to file headers. Blank ids are skipped; a later row
    replaces an earlier one of the same id but keeps its place.
    """
    names = columns or {}
    def text(c):
        return strip(F.coalesce(_optional(df, names.get(c, c)), F.lit("")))
    rows = df.select(
        "row_index", text("dept_id").alias("dept_id"), text("dept_name_zh").alias("name_zh"),
        text("dept_name_en").alias("name_en"), _word_list(_optional(df, names.get("aliases", "aliases"))).alias("aliases"),
        _word_list(_optional(df, names.get("keywords", "keywords"))).alias("keywords")).where("dept_id <> ''")
    return (rows.groupBy("dept_id").agg(
        F.max_by(F.struct("name_zh", "name_en", "aliases", "keywords"), "row_index").alias("r"),
        F.min("row_index").alias("lib_order")).select("dept_id", "r.*", "lib_order"))


def read_department_library(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    return department_library(read_table(spark, path, ","), columns)


def staff_library(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(employee_id, name_zh, dept_id, name_en, email, position, research_area, lib_order)."""
    names = columns or {}
    def text(c):
        return strip(F.coalesce(_optional(df, names.get(c, c)), F.lit("")))
    optional = [F.nullif(text(c), F.lit("")).alias(c) for c in ("name_en", "email", "position", "research_area")]
    return df.select(text("employee_id").alias("employee_id"), text("name_zh").alias("name_zh"),
                     F.lower(text("dept_id")).alias("dept_id"), *optional,
                     F.col("row_index").alias("lib_order")).where("employee_id <> ''")


def read_staff_library(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    return staff_library(read_table(spark, path, ","), columns)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_registry_works(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.REGISTRY_WORK)


def read_openalex_works(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.OPENALEX_WORK)


def read_page_sidecars(spark: SparkSession, folder: str, dois: DataFrame | None = None) -> DataFrame:
    df = read_json(spark, f"{folder}/*_page_author_data.json", schemas.PAGE_SIDECAR, True)
    return df if dois is None else df.join(dois.select("doi").distinct(), "doi", "left_semi")


def read_ocr_sidecars(spark: SparkSession, folder: str, dois: DataFrame | None = None) -> DataFrame:
    """OCR sidecars of a folder; with ``dois`` only those of the given papers."""
    df = read_json(spark, f"{folder}/*_ocr_sidecar.json", schemas.OCR_SIDECAR, True)
    return df if dois is None else df.join(dois.select("doi").distinct(), "doi", "left_semi")


def numbered_lines(texts: DataFrame, head: int = 60, tail: int = 0, split: Callable[[Column], Column] = lines) -> DataFrame:
    """(doi, line_no, line) of the first ``head`` and last ``tail`` lines, numbers of four digits or more.

    Lines shown in the head are not repeated as tail unless the tail reaches into it. ``split`` cuts a text into lines.
    """
    rows = texts.select("doi", split(F.col("text")).alias("ls"))
    total = F.size("ls")
    spread = rows.select("doi", total.alias("n"), F.posexplode("ls").alias("i", "line"))
    return (spread.where((F.col("i") < head) | (F.col("i") >= F.col("n") - tail))
            .select("doi", (F.col("i") + 1).alias("line_no"),
                    F.format_string("%04d: %s", F.col("i") + 1, F.col("line")).alias("line")))


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored parquet table with its declared schema."""
    return spark.read.schema(schema).parquet(path)
