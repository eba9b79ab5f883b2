"""Numbering rows within a group without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 65536


def rank_within(df: DataFrame, keys: list[str], pos: str, ties: list[str] | None = None,
                name: str = "rank", bucket: int = BUCKET) -> DataFrame:
    """1-based row number per ``keys`` in the order (``pos``, ``ties``).

    ``pos`` is an integer column. Rows are numbered inside buckets of ``bucket``
    consecutive positions, and bucket counts (one small row each) give the offsets, so
    a group that holds a third of the table still spreads over many tasks.
    """
    order = [F.col(pos)] + [F.col(c) for c in (ties or [])]
    cut = df.withColumn("_bucket", F.floor(F.col(pos) / bucket))
    counts = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .where("_before > 0").drop("_n"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (cut.withColumn("_local", local)
            .join(offsets, [*keys, "_bucket"], "left")
            .withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("int"))
            .drop("_bucket", "_local", "_before"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; Spark prunes each task to k rows before shuffling."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).withColumnRenamed("_place", "place")
