"""Exact dedup by a tree merge of sorted digest runs.

Every input partition is a run: its digests, folded to one row per digest. In each round the runs that share a
slot number divided by ``fan_in`` meet: the shuffle deals their rows by (slot, digest), sort-merges them and folds
equal digests, keeping the identifier that stays and the number of rows. After log(runs) rounds one slot is left.
A digest held by a third of all rows is one row per run from the first round on, so no task sees the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.llm.staging import staged, tagged_once, text_or_empty

KEY = ["_digest", "_bytes", "_check"]


def _best(prefer: str) -> Column:
    """The row that stays: largest or smallest id; a null id loses; of equal ids the first row of the table."""
    known = F.col("_id").isNotNull()
    if prefer == "largest":
        return F.max(F.struct(known.alias("known"), F.col("_id").alias("id"), (-F.col("_tag")).alias("turn")))
    return F.min(F.struct((~known).alias("known"), F.col("_id").alias("id"), F.col("_tag").alias("turn")))


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int, prefer: str) -> DataFrame:
    """One row per digest: ``_best`` (struct) and ``_n``. ``runs`` has ``_slot``, KEY, ``_id`` and ``_tag``."""
    level = runs.groupBy("_slot", *KEY).agg(_best(prefer).alias("_best"), F.count(F.lit(1)).alias("_n"))
    pick = F.max if prefer == "largest" else F.min
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        level = (level.withColumn("_slot", F.floor(F.col("_slot") / fan_in).cast("int"))
                 .groupBy("_slot", *KEY).agg(pick("_best").alias("_best"), F.sum("_n").alias("_n")))
    return level.drop("_slot")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_tag", F.monotonically_increasing_id())


def _groups(docs: DataFrame, id_col: str, text_col: str, prefer: str, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(narrow rows with their digests, groups of two rows or more). ``docs`` has ``_tag``."""
    text = text_or_empty(F.col(text_col))
    rows = staged(docs.select(F.col(id_col).alias("_id"), "_tag", F.unhex(F.sha2(text, 256)).alias("_digest"),
                              F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check"),
                              F.spark_partition_id().alias("_slot")))
    n_runs = (rows.agg(F.max("_slot")).first()[0] or 0) + 1
    groups = merge_runs(rows, n_runs, fan_in, prefer).where("_n > 1")
    return rows.drop("_slot"), groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefer: str = "largest",
                     fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when SHA-256, byte length and a second 64-bit hash agree; null counts as empty, nothing else is
    normalised. ``prefer`` says whether the largest or smallest id of a group stays. Rows without an id stay only
    if no row of their group has one; of repeated rows with one id the first of the table stays, so every group
    keeps exactly one row. An empty table gives an empty result; further columns of ``docs`` are not read.
    """
    rows, groups = _groups(_tagged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))),
                           "_id", "_text", prefer, fan_in)
    joined = rows.join(groups, KEY, "left")
    alone = F.col("_n").isNull()
    return joined.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.abs("_best.turn") == F.col("_tag"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefer: str = "largest",
                          fan_in: int = 8) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` does not keep. The rows are numbered once, in a stored copy."""
    tagged, tag = tagged_once(docs)
    narrow = tagged.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(tag).alias("_tag"))
    rows, groups = _groups(narrow, "_id", "_text", prefer, fan_in)
    losers = rows.join(groups, KEY).where(F.abs("_best.turn") != F.col("_tag")).select(F.col("_tag").alias(tag))
    return tagged.join(losers, tag, "left_anti").drop(tag)
