"""Publishing a batch: both tables are written aside, then one pointer makes them current.

A root folder holds ``versions/<batch>/<table>/bucket=<n>`` and the pointer, a small file that names the version of each
bucket and the batches published so far. Only buckets with a paper of the batch are rewritten. Until the pointer is
replaced, readers see the old state of both tables; a batch that died half way is written again under its name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byline import schemas
from byline.operators.sinks import doi_bucket, merge_papers, replace_authors, table_exists
from byline.session import cut_lineage

TABLES = {"papers": schemas.PAPERS, "paper_authors": schemas.PAPER_AUTHORS}
POINTER = "CURRENT"


def read_pointer(spark: SparkSession, root: str) -> dict:
    """Published batches, and for each table the version of each bucket."""
    if not table_exists(spark, f"{root}/{POINTER}"):
        return {"batches": [], **{table: {} for table in TABLES}}
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()["value"])


def _write_pointer(spark: SparkSession, root: str, state: dict) -> None:
    """Replace the pointer in one step: written beside it, then renamed over it."""
    fs = spark._jvm.org.apache.hadoop.fs
    fresh, place = fs.Path(f"{root}/{POINTER}.new"), fs.Path(f"{root}/{POINTER}")
    conf = spark._jsc.hadoopConfiguration()
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf)
    context.rename(fresh, place, options)


def read_published(spark: SparkSession, root: str, table: str, buckets: list[int] | None = None) -> DataFrame:
    """The current rows of a table, of some buckets if given; an unpublished root has none."""
    versions = read_pointer(spark, root)[table]
    paths = [f"{root}/versions/{version}/{table}/bucket={bucket}" for bucket, version in versions.items()
             if buckets is None or int(bucket) in buckets]
    return spark.read.schema(TABLES[table]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[table])


def _written(spark: SparkSession, path: str) -> set[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return {name.removeprefix("bucket=") for name in names if name.startswith("bucket=")}


def publish(root: str, batch: str, papers: DataFrame, authors: DataFrame, dois: DataFrame, buckets: int = 256) -> bool:
    """Merge ``papers``, replace the authors of ``dois`` by ``authors``, and make both current at once (runs jobs).

    ``papers``: doi and any of title, journal, publish_date, status. A batch that is already published changes
    nothing and gives False. A root keeps the number of buckets it began with; one batch is published at a time. The driver sees bucket numbers only.
    """
    spark = papers.sparkSession
    state = read_pointer(spark, root)
    if batch in state["batches"]:
        return False
    buckets = state.setdefault("buckets", buckets)
    papers, dois = cut_lineage(papers), cut_lineage(dois.select("doi").distinct())
    touched = sorted(r["b"] for r in papers.select("doi").unionByName(dois).select(doi_bucket(F.col("doi"), buckets).alias("b")).distinct().collect())
    merged = {"papers": merge_papers(read_published(spark, root, "papers", touched), papers),
              "paper_authors": replace_authors(read_published(spark, root, "paper_authors", touched), authors, dois)}
    for table, rows in merged.items():
        key = "doi" if table == "papers" else "paper_doi"
        declared = spark.createDataFrame([], TABLES[table]).schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared])
        (rows.withColumn("bucket", doi_bucket(F.col(key), buckets)).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/versions/{batch}/{table}"))
    for table in TABLES:
        written = _written(spark, f"{root}/versions/{batch}/{table}")
        kept = {b: v for b, v in state[table].items() if int(b) not in set(touched)}
        state[table] = kept | dict.fromkeys(written, batch)
    state["batches"].append(batch)
    _write_pointer(spark, root, state)
    return True
