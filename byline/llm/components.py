"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.llm.staging import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (least node that links reach) for every node of ``edges``; nodes are comparable and not null.

    Each round every node points to the least of itself and its neighbours, the pointers are followed once more, and
    the edges are rewritten to what their ends point to; ends that meet are done. Rewritten edges are fewer each
    round, and a star of any size, with its hub the least, contracts at once. Minima are combined before the
    shuffle, so a hub is no hot key; joins on a hub can be split. Each round is stored in the shared folder.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        up = staged(up)
        twice = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"))
        twice = staged(twice)
        left = staged(
            left.join(twice.select(F.col("node").alias("a"), F.col("to").alias("p")), "a")
            .join(twice.select(F.col("node").alias("b"), F.col("to").alias("q")), "b")
            .where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        if label is None:
            label = twice.select("node", F.col("to").alias("component"))
        else:
            moved = twice.select(F.col("node").alias("component"), "to")
            label = staged(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
