"""The trie of conversation prefixes, with subtree totals rolled up by bands of depth.

Conversations that start alike share a node. A node is named by its smallest member and its depth, and the path of
that member from the root names all its ancestors. Depths are cut into bands of fixed height. Inside a band a node's
values go straight to its ancestors there, at most one row per level of the band. The nodes on top of the bands, with the totals
of their bands, form a trie that is lower by the height of a band; it is rolled up in the same way, and the completed totals
of band tops go to the ancestors in the band above. A trie of depth D takes log D rounds and no row meets
more than a band of others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byline.llm.staging import staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1024
RANGE_ROWS = 200_000


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv_id``, ``rank`` (from 0), ``turn_digest`` (SHA-256 of role and text) and ``words`` of every turn.

    Turns stand in order of ``turn``, null first; equal ones in order of their digests. Null role and text count as empty; rows without a conversation
    are left out. Rows are dealt to ranges of (conversation, turn), numbered there, and offset by what the
    ranges before hold of the same conversation, so one of any length spreads over tasks.
    """
    role, text = text_or_empty(F.col(role_col)), text_or_empty(F.col(text_col))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ranges = max(1, -(-conversations.count() // RANGE_ROWS))
    order = [F.col("turn").asc_nulls_first(), F.col("turn_digest")]
    dealt = staged(turns.repartitionByRange(ranges, F.col("conv_id"), *order).withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").drop("_n")
    place = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    return (dealt.withColumn("_place", place).join(offsets, ["conv_id", "_part"], "left")
            .select("conv_id", (F.col("_place") - 1 + F.coalesce("_before", F.lit(0))).alias("rank"), "turn_digest", "words"))


def with_shared_heads(ranked: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first conversation of their family.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all if fewer, none if absent), h being
    crc32(c) % ``heads``, then its own turns after its first h. Returns turns (conv_id, depth from 1, turn_digest, words) and
    conversations (conv_id, n_turns), those without turns included.
    """
    ranked = staged(ranked)
    own = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % family})
    bases = own.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = staged(own.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    first = ranked.where((F.col("conv_id") % family == 0) & (F.col("rank") < heads - 1)).select(F.col("conv_id").alias("base"), "rank", "turn_digest", "words")
    lent = convs.join(first, "base").where("rank < k").select("conv_id", (F.col("rank") + 1).alias("depth"), "turn_digest", "words")
    kept = (ranked.join(convs.select("conv_id", "h", "k"), "conv_id").where("rank >= h")
            .select("conv_id", (F.col("k") + F.col("rank") - F.col("h") + 1).alias("depth"), "turn_digest", "words"))
    return lent.unionByName(kept), convs.select("conv_id", "n_turns")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``x`` and ``y``: 128 bits that name the sequence up to each turn.

    They are the exclusive or of the hashes of (depth, turn), which can be taken block by block of a long conversation.
    """
    rows = staged(turns.withColumns({"_b": F.floor((F.col("depth") - 1) / BLOCK), "_x": F.xxhash64("turn_digest", "depth"),
                                     "_y": F.xxhash64("depth", F.lit("second"), "turn_digest")}).drop("turn_digest"))
    blocks = rows.groupBy("conv_id", "_b").agg(F.bit_xor("_x").alias("_bx"), F.bit_xor("_y").alias("_by"))
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_b", F.bit_xor("_bx").over(before).alias("_bx"), F.bit_xor("_by").over(before).alias("_by")).where("_b > 0")
    so_far = Window.partitionBy("conv_id", "_b").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    made = rows.withColumns({"x": F.bit_xor("_x").over(so_far), "y": F.bit_xor("_y").over(so_far)}).join(blocks, ["conv_id", "_b"], "left")
    return made.select("conv_id", "depth", "words", F.col("x").bitwiseXOR(F.coalesce("_bx", F.lit(0))).alias("x"),
                       F.col("y").bitwiseXOR(F.coalesce("_by", F.lit(0))).alias("y"))


def roll_up(paths: DataFrame, values: list[str], height: int = 16) -> DataFrame:
    """Subtree totals of ``values``: ``rep``, ``depth`` and one column each.

    ``paths`` has, for conversations and their depths, the node there (``rep``, its smallest member) and the
    values, which count where the conversation is itself the smallest member.
    """
    owned = F.col("rep") == F.col("conv_id")
    paths = paths.select("conv_id", "depth", "rep", F.floor(F.col("depth") / height).alias("band"), *[F.when(owned, F.coalesce(v, F.lit(0))).otherwise(0).alias(v) for v in values])
    below = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(v).alias(v) for v in values]
    inside = paths.select("rep", "depth", *[F.sum(v).over(below).alias(v) for v in values], F.max(owned.cast("int")).over(below).alias("_any")).where("_any = 1")
    inside = staged(inside.groupBy("rep", "depth").agg(*sums))
    if (inside.agg(F.max("depth")).first()[0] or 0) < height:
        return inside
    lower = lambda at: (F.col(at) / height).cast("long").alias("depth")
    tops = inside.where(f"depth % {height} = 0").select(F.col("rep").alias("conv_id"), lower("depth"), *values)
    above = paths.where(f"depth % {height} = 0").select("conv_id", lower("depth"), "rep").join(tops, ["conv_id", "depth"], "left")
    totals = roll_up(staged(above), values, height).where("depth > 0")
    sent = totals.select(F.col("rep").alias("conv_id"), (F.col("depth") - 1).alias("band"), *values)
    sent = paths.select("conv_id", "band", "rep", "depth").join(sent, ["conv_id", "band"]).select("rep", "depth", *values)
    return staged(inside.unionByName(sent).groupBy("rep", "depth").agg(*sums))


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending ids of a batch as one comma-joined text per node."""
    for batch in batches:
        table = pa.table(batch.to_pydict() if not batch.num_rows else {c: batch.column(c) for c in ("rep", "depth", "conv_id")})
        if not len(table):
            continue
        groups = table.group_by(["rep", "depth"], use_threads=False).aggregate([("conv_id", "list"), ("conv_id", "min")])
        text = pc.binary_join(pc.cast(groups.column("conv_id_list").combine_chunks(), pa.list_(pa.string())), ",")
        yield pa.record_batch({"rep": groups.column("rep").combine_chunks(), "depth": groups.column("depth").combine_chunks(),
                               "first": groups.column("conv_id_min").combine_chunks(), "ids": text})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts in order; the rows of a node are consecutive."""
    at, state = None, None
    for batch in batches:
        for rep, depth, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids")), strict=True):
            if (rep, depth) != at:
                if at is not None:
                    yield pa.record_batch({"rep": [at[0]], "depth": [at[1]], "ends_sha256": [state.hexdigest()]})
                at, state = (rep, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if at is not None:
        yield pa.record_batch({"rep": [at[0]], "depth": [at[1]], "ends_sha256": [state.hexdigest()]})


def ends_digests(ends: DataFrame, few: int = 1000) -> DataFrame:
    """``rep``, ``depth``, ``ends_sha256``: digest of each node's comma-joined ascending ids. ``ends``: rep, depth, conv_id, n_ends.

    Lists of at most ``few`` ids are joined in one row. Longer ones are cut over ranges of ids, joined there to
    texts, and the texts, one for some thousand ids, are hashed one after the other: no list is held whole.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    short = ends.where(F.col("n_ends") <= few).groupBy("rep", "depth").agg(F.sha2(joined, 256).alias("ends_sha256"))
    long = ends.where(F.col("n_ends") > few).select("rep", "depth", "conv_id")
    rows = long.count()
    if not rows:
        return short
    order = ["rep", "depth", "conv_id"]
    texts = staged(long.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order).sortWithinPartitions(*order)
                   .mapInArrow(_joined_runs, "rep long, depth long, first long, ids string"))
    hashed = texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(_digests, "rep long, depth long, ends_sha256 string")
    return short.unionByName(hashed)


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = 16) -> DataFrame:
    """One row per distinct prefix of conversations, the empty one (root) included.

    ``turns``: conv_id, depth (1, 2, ... in each conversation), turn_digest and words; ``convs``: conv_id and n_turns, each once.
    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (summed over the subtree: words of a node's last turn times its
    members less one) and ends_sha256 (digest of the ids that end here). An empty table has no node. Turns are
    compared by SHA-256, prefixes by 128 bits.
    """
    convs = staged(convs)
    root = convs.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("n_turns") == 0).cast("long")), F.lit(0)).alias("ends")).first()
    made = staged(_prefixes(turns).join(convs, "conv_id").withColumn("last", F.col("depth") == F.col("n_turns")).drop("n_turns"))
    nodes = made.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    paths = made.join(nodes, ["depth", "x", "y"]).select("conv_id", "depth", "rep", "words", "last", "n_convs", "n_ends")
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root["rep"]).cast("long").alias("rep"), F.lit(0).cast("long").alias("words"),
                         (F.col("n_turns") == 0).alias("last"), F.lit(root["n"]).alias("n_convs"), F.lit(root["ends"]).alias("n_ends"))
    paths = staged(paths.unionByName(start))
    mine = paths.where("rep = conv_id").drop("rep", "last")
    parents = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    mine = staged(mine.join(parents, ["conv_id", "depth"], "left"))
    children = mine.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    mine = staged(mine.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}))
    valued = paths.select("conv_id", "depth", "rep").join(mine.select("conv_id", "depth", "leaves", "saved"), ["conv_id", "depth"], "left")
    totals = roll_up(valued, ["leaves", "saved"], height).withColumnsRenamed({"rep": "conv_id", "leaves": "n_leaves", "saved": "saved_tokens"})
    ends = ends_digests(paths.where("last").select("rep", "depth", "conv_id", "n_ends")).withColumnRenamed("rep", "conv_id")
    return (mine.join(totals, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, height: int = 16) -> DataFrame:
    """``prefix_trie`` of a table of turns (conv_id, turn, role, text) as it stands; see ``ordered_turns`` for odd rows."""
    ranked = staged(ordered_turns(conversations))
    return prefix_trie(ranked.withColumn("depth", F.col("rank") + 1).drop("rank"), ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")), height)
