"""Merging results into stored tables and writing output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.functions.text import repair_text, strip
from byline.operators.details import PART
from byline.schemas import PAPER_AUTHORS
from byline.session import cut_lineage


def replace_authors(existing: DataFrame, fresh: DataFrame, dois: DataFrame) -> DataFrame:
    """paper_authors after deleting all rows of ``dois`` and adding ``fresh``."""
    gone = dois.select(F.col("doi").alias("paper_doi")).distinct()
    return existing.join(gone, "paper_doi", "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_papers(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """papers with new rows added and given (non-NULL) fields updated, by DOI.

    ``fresh`` may hold any of title, journal, publish_date, status. A paper that did not
    exist starts as PROCESSING unless a status is given.
    """
    new = fresh.select("doi", *[
        (F.col(c) if c in fresh.columns else F.lit(None).cast("string")).alias(f"_{c}")
        for c in ("title", "journal", "publish_date", "status")])
    both = existing.join(new, "doi", "full_outer")
    return both.select(
        "doi", *[F.coalesce(f"_{c}", c).alias(c) for c in ("title", "journal", "publish_date")], "pdf_path",
        F.coalesce("_status", "status", F.lit("PROCESSING")).alias("status"),
        F.coalesce("created_at", F.localtimestamp()).alias("created_at"))


def doi_bucket(doi: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doi), F.lit(buckets)).cast("int")


def write_paper_authors(fresh: DataFrame, dois: DataFrame, path: str, buckets: int = 1024) -> None:
    """Replace the authors of ``dois`` in the table at ``path`` (runs jobs).

    The table is partitioned by a hash bucket of the DOI; only buckets that hold an
    affected DOI are read and rewritten. The merged rows are checkpointed before the
    overwrite, so a lost executor cannot force a re-read of half-replaced files.
    """
    spark = fresh.sparkSession
    keyed = dois.select("doi").distinct().withColumn("bucket", doi_bucket(F.col("doi"), buckets))
    add = fresh.withColumn("bucket", doi_bucket(F.col("paper_doi"), buckets))
    if table_exists(spark, path):
        # The declared schema keeps column types stable; partition filters prune files.
        stored = spark.read.schema(PAPER_AUTHORS + ", bucket INT").parquet(path)
        touched = stored.join(keyed.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(keyed.select(F.col("doi").alias("paper_doi")), "paper_doi", "left_anti")
        add = cut_lineage(kept.unionByName(add, allowMissingColumns=True))
        # A bucket left without rows is not rewritten by a dynamic overwrite; it goes last, when all else is stored.
        empty = cut_lineage(keyed.select("bucket").distinct().join(add.select("bucket").distinct(), "bucket", "left_anti"))
    else:
        empty = None
    (add.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    if empty is not None:
        _drop_buckets(empty, path)


def table_exists(spark, path: str) -> bool:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _drop_buckets(buckets: DataFrame, path: str) -> None:
    """Remove partitions; at most one path per bucket number reaches the driver."""
    spark = buckets.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path
    for row in buckets.toLocalIterator():
        target = folder(f"{path}/bucket={row.bucket}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def result_records(statuses: DataFrame, vision: DataFrame, authors: DataFrame) -> DataFrame:
    """(doi, status, part, authors): the list to report per paper.

    ``vision`` and ``authors``: (doi, pos, name, affiliation, is_corresponding,
    is_co_first, source). The vision list is preferred whenever the paper has one,
    including an explicitly empty one given by rows with pos NULL.
    """
    seen = vision.select("doi").distinct()
    rows = vision.unionByName(authors.join(seen, "doi", "left_anti")).where(F.col("pos").isNotNull())
    author = F.struct("pos", repair_text(F.col("name")).alias("name"),
                      repair_text(F.col("affiliation")).alias("affiliation"),
                      "is_corresponding", "is_co_first", "source")
    nested = (rows.withColumn("author", author)
              .withColumn("part", F.floor((F.col("pos") - 1) / PART).cast("int"))
              .groupBy("doi", "part").agg(F.array_sort(F.collect_list("author")).alias("authors")))
    none = F.array().cast(nested.schema["authors"].dataType)
    return (statuses.select("doi", "status").join(nested, "doi", "left")
            .select("doi", "status", F.coalesce("part", F.lit(0)).alias("part"),
                    F.coalesce("authors", none).alias("authors")))


def write_result_json(records: DataFrame, path: str) -> None:
    """One JSON object per line (runs a job)."""
    records.write.mode("overwrite").json(path)


def parse_box(box: Column) -> Column:
    """JSON [[x, y], ...] or flat [x1, y1, ...] as ARRAY<STRUCT<x, y>>; NULL if neither."""
    nested = F.from_json(box, "array<array<double>>")
    flat = F.from_json(box, "array<double>")
    is_nested = box.rlike(r"^\s*\[\s*\[")  # written with or without line breaks
    pairs = F.when(F.size(flat) >= 2, F.transform(
        F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1),
        lambda i: F.array(F.get(flat, i * 2), F.get(flat, i * 2 + 1))))
    points = F.filter(F.when(is_nested, nested).otherwise(pairs), lambda p: F.size(p) >= 2)
    return F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def sidecar_records(pages: DataFrame, max_chars: int | None = None, max_items: int | None = None,
                    without_text: bool = False) -> DataFrame:
    """OCR sidecars of pages (doi, image_path, ocr_text, ocr_items), whole unless a cut is asked for.

    Items hold text, score and a JSON box. Pages without image have no sidecar, nor do pages without text unless
    ``without_text`` asks for them.
    """
    items = F.col("ocr_items") if max_items is None else F.slice("ocr_items", 1, max_items)
    text = F.col("ocr_text") if max_chars is None else F.substring("ocr_text", 1, max_chars)
    boxes = F.transform(items, lambda i: F.struct(
        F.coalesce(i["text"], F.lit("")).alias("text"), i["score"].alias("score"),
        F.transform(parse_box(i["box"]), lambda p: F.array(p["x"], p["y"])).alias("box")))
    kept = F.length(strip("image_path")) > 0
    return (pages.where(kept if without_text else kept & (F.length("ocr_text") > 0))
            .select("doi", "image_path", text.alias("ocr_text"),
                    F.coalesce(boxes, F.array().cast(
                        "array<struct<text:string,score:double,box:array<array<double>>>>")).alias("ocr_items")))


def write_sidecars(pages: DataFrame, path: str) -> None:
    sidecar_records(pages).write.mode("overwrite").json(path)
