"""Intermediate tables in the cluster's shared folder, and row blocks of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a lineage cut that outlives executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tagged_once(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and that column's name, which no other column has.

    Numbers given in a scan change with the number of cores at that time; stored ones do not.
    """
    tag = "_tag"
    while tag in docs.columns:
        tag += "_"
    return staged(docs.withColumn(tag, F.monotonically_increasing_id())), tag


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts of ``docs`` fill: grows with the input."""
    total = docs.select(F.sum(F.octet_length(text_or_empty(F.col(text)))).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


def in_blocks(rows: DataFrame, key: list[str], blocks: int, name: str = "block") -> DataFrame:
    """Adds a block number drawn from a hash of ``key``, which should differ from row to row."""
    return rows.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))


#: Bits of the filter in ``likely_in``: 2,048 bitmaps of 4 KB, 8 MB in all, whatever the number of keys.
FILTER_BITS = 1 << 26


def likely_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` may be among those of ``keys``: none that is gets lost, most others go before any shuffle.

    The keys are hashed into bitmaps of a fixed size, the only thing that is broadcast. With 3 million keys one in
    twenty other rows stays; with far more the filter lets everything pass and the join after it does all the work.
    """
    place = lambda: F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    maps = (keys.select(place().alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits")))
    at = rows.withColumn("_at", place()).withColumns({"_bucket": F.bitmap_bucket_number("_at"), "_bit": F.bitmap_bit_position("_at")})
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")) % 2 == 1
    return at.join(F.broadcast(maps), "_bucket").where(set_).drop("_at", "_bucket", "_bit", "_bits")
