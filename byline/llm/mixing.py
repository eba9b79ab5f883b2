"""Mixing sources to target weights by entropy balancing.

Every document gets a rate of at most ``cap`` copies. Of all rates whose tokens meet the targets of the sources, the
ones nearest to one copy each (in the entropy of a rate between 0 and the cap) have the form
``cap / (1 + (cap - 1) * exp(-lam * size / scale))`` with one multiplier ``lam`` per source: exponentially tilted odds.
The multipliers are the optimum of a convex dual, found by Newton steps kept inside a bracket. A document's rate
depends on its source and size alone, so the steps run over the counts per (source, size); the constraints of
different sources share no document, so the dual's Hessian is diagonal and all sources step at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from byline.llm.staging import staged, text_or_empty

#: Relative miss of a target at which the Newton steps end, and the most steps taken.
PRECISION, STEPS = 1e-9, 60
SALTS = 64


def word_count(text: Column) -> Column:
    """The number of runs of characters other than ASCII blanks."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """One row per source: ``_src``, ``source_size``, ``target``.

    Sources in code point order, null last, take the weights in turn. Together they get ``share`` of all tokens, by
    weight; none more than ``cap`` times its size, what is over being shared again. That is min(cap * size, level *
    weight): the level follows from sums over the sources in order of cap * size / weight. One row per source is
    all that meets here.
    """
    per = sizes.groupBy("_src").agg(F.sum(F.col("_size") * F.col("_n")).cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    per = per.withColumn("_w", weight).withColumn("_full_at", limit / F.col("_w"))
    up = Window.orderBy("_full_at", F.col("_src").asc_nulls_last())
    earlier, later = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (everything - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))) / F.sum("_w").over(later)
    ranked = per.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_full_at"))
    reached = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (ranked.withColumn("_level", reached)
            .select("_src", "source_size", F.least(limit, F.coalesce(F.col("_level") * F.col("_w"), limit)).alias("target")))


def _named(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def rate(lam: Column, x: Column, cap: float) -> Column:
    return F.lit(cap) / (1 + F.lit(cap - 1) * F.exp(-lam * x))


def balanced(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with ``_lam`` and ``_scale``; ``_lam`` is null where the target is the cap or nothing is to be taken."""
    mean = sizes.where("_size > 0").groupBy("_src").agg((F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("_scale"))
    tied = F.col("_key").eqNullSafe(F.col("_src"))
    state = targets.join(mean.withColumnRenamed("_src", "_key"), tied, "left").drop("_key")
    solvable = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)
    state = staged(state.withColumns({"_lam": F.when(solvable, 0.0), "_lo": F.lit(float("-inf")), "_hi": F.lit(float("inf")),
                                      "_done": ~solvable}))
    counts = sizes.where("_size > 0").withColumnRenamed("_src", "_key")
    for _ in range(STEPS):
        x = F.col("_size") / F.col("_scale")
        w, tokens = rate(F.col("_lam"), x, cap), F.col("_size") * F.col("_n")
        sums = (counts.join(state.where("not _done").select("_src", "_lam", "_scale"), tied)
                .groupBy("_key").agg(F.sum(tokens * w).alias("_taken"), F.sum(tokens * x * w * (1 - w / cap)).alias("_slope")))
        gap, lam = F.col("_taken") - F.col("target"), F.col("_lam")
        lo, hi = F.when(gap < 0, lam).otherwise(F.col("_lo")), F.when(gap > 0, lam).otherwise(F.col("_hi"))
        newton = F.when(F.col("_slope") > 0, lam - gap / F.col("_slope"))
        inf = float("inf")
        middle = F.when((lo > -inf) & (hi < inf), (lo + hi) / 2).when(lo > -inf, F.abs(lo) * 2 + 1).otherwise(-F.abs(hi) * 2 - 1)
        # outside the bracket, or far from the last step, halving or doubling is safer than Newton
        step = F.when((newton > lo) & (newton < hi) & (F.abs(newton - lam) <= F.abs(lam) * 4 + 4), newton).otherwise(middle)
        still = ~F.col("_done") & (F.abs(gap) > F.col("target") * PRECISION)
        state = staged(state.join(sums, tied, "left").select(
            "_src", "source_size", "target", "_scale", F.when(still, step).otherwise(lam).alias("_lam"),
            F.when(still, lo).otherwise(F.col("_lo")).alias("_lo"), F.when(still, hi).otherwise(F.col("_hi")).alias("_hi"),
            (~F.coalesce(still, F.lit(False))).alias("_done")))
        if state.where("not _done").limit(1).count() == 0:
            break
    return state.drop("_lo", "_hi", "_done")


def _whole_copies(cap: float):
    """Rounds expected copies to whole ones source by source, largest documents first.

    Each size takes the number of copies that brings the source's tokens so far nearest to what is expected so
    far, so the miss left at the end is that of the smallest documents. A source has one row per distinct size.
    """
    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        rows = batch.sort_values("_size", ascending=False)
        due, made, copies = 0.0, 0, []
        for size, n, expected in zip(rows["_size"].tolist(), rows["_n"].tolist(), rows["_expected"].tolist(), strict=True):
            due += size * expected
            take = min(int(cap * n), max(0, round((due - made) / size) if size else round(expected)))
            made += take * size
            copies.append(take)
        return rows.assign(_copies=copies)[["_src", "_size", "_n", "_copies"]]
    return fold


def mixed(docs: DataFrame, weights: list[float] | None = None, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to ``cap``); such columns are replaced.

    Null texts are empty, have size 0, keep one copy and count for nothing; null sources form one source. Copies
    of equally large documents of a source go to the first in the order of a hash of the id and text, so reruns agree;
    repeated rows are separate documents. An empty table gives an empty result. Nothing per document is gathered:
    the balance needs counts per (source, size), and those of equal size are numbered in ``SALTS`` parts.
    """
    weights = weights or [5, 2, 1]
    made = ["size", "source_size", "target", "copies"]
    rows = docs.drop(*made).withColumn("_size", word_count(F.col(text_col))).withColumn("_src", F.col(source_col).cast("string"))
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = rows.withColumns({"_turn": order, "_salt": F.pmod(order, F.lit(SALTS)).cast("int"), "_named": _named(F.col("_src"))})
    narrow = staged(rows.groupBy("_src", "_size", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    sizes = narrow.groupBy("_src", "_size").agg(F.sum("_n").alias("_n"))
    targets = source_targets(sizes, weights, share, cap)
    state = balanced(sizes, targets, cap)
    tied = F.col("_key").eqNullSafe(F.col("_src"))
    lam = F.col("_lam")
    each = (F.when(F.col("_size") == 0, 1.0).when(lam.isNotNull(), rate(lam, F.col("_size") / F.col("_scale"), cap))
            .when(F.col("target") > 0, float(cap)).otherwise(0.0))
    expected = (sizes.withColumnRenamed("_src", "_key").join(state, tied)
                .select("_src", "_size", "_n", (each * F.col("_n")).alias("_expected")))
    whole = expected.groupBy("_src").applyInPandas(_whole_copies(cap), "_src string, _size long, _n long, _copies long")
    # the copies of a size are dealt to its salts in proportion, then to the rows of a salt in order
    before = Window.partitionBy("_src", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)
    part = narrow.withColumn("_upto", F.sum("_n").over(before))
    same = F.col("_size").eqNullSafe(F.col("_zise")) & F.col("_key").eqNullSafe(F.col("_src"))
    dealt = (part.withColumnsRenamed({"_src": "_key", "_size": "_zise", "_n": "_in"}).join(whole, same)
             .withColumn("_to", F.floor(F.col("_copies") * F.col("_upto") / F.col("_n")))
             .withColumn("_from", F.floor(F.col("_copies") * (F.col("_upto") - F.col("_in")) / F.col("_n")))
             .select("_src", "_size", "_salt", (F.col("_to") - F.col("_from")).alias("_part"), F.col("_in"))
             .join(state.select(F.col("_src").alias("_key"), "source_size", "target"), F.col("_key").eqNullSafe(F.col("_src")))
             .select(_named(F.col("_src")).alias("_named"), "_size", "_salt", "_part", "_in", "source_size", "target"))
    return _deal(rows, dealt).drop("_src").withColumnRenamed("_size", "size").select(
        *[c for c in docs.columns if c not in made], *made)


def _deal(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Adds ``copies``: every row of a part gets the same whole number, the first of them one more.

    Rows are placed and then joined by the same columns, none of them null, so whole texts are shuffled and sorted once.
    """
    part = ["_named", "_size", "_salt"]
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy("_turn")))
    extra = F.col("_place") <= F.col("_part") % F.col("_in")
    one = F.when(F.col("_in") == 1, F.col("_part")).otherwise(F.floor(F.col("_part") / F.col("_in")) + extra.cast("long"))
    return placed.join(dealt, part).withColumn("copies", one.cast("int")).drop("_named", "_place", "_part", "_in", "_turn", "_salt")


def repeated(docs: DataFrame, copies_col: str = "copies") -> DataFrame:
    """Each row as often as its copies say; none for 0 or null."""
    times = F.explode(F.sequence(F.lit(1), F.col(copies_col)))
    return docs.where(F.col(copies_col) > 0).withColumn("_time", times).drop("_time", copies_col)
