"""Spelling variants by a dictionary of trie-node pairs.

The words are sorted and their prefixes numbered as nodes of a trie, then the same is done with the words read
backwards. A word is thus known at every position by two integers: the node of what stands before and the node of
what stands after. Words that differ by a replaced letter share the pair around the letter that is skipped; a word
with a letter put in shares, around that letter, the pair between two letters of the shorter word. Node numbers are
exact, so these joins find all neighbours and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.llm.staging import staged, text_or_empty
from byline.llm.urls import LOWER, UPPER

LETTERS = r"A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text",
                change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word`` and ``n``: the letter runs of all texts, A-Z lower-cased, of ``min_length`` code points and ``min_count``
    occurrences at least. ``change`` (id and run to word) may rewrite runs before they are counted. Null texts have none.
    """
    run = F.explode(F.regexp_extract_all(F.translate(text_or_empty(F.col(text_col)), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
    word = F.col("_run") if change is None else change(F.col("_id"), F.col("_run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _local_nodes(keys: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nodes of ascending ``keys`` in order of birth: all keys' paths in a row, their lengths, and the number of nodes."""
    flat: list[int] = []
    path: list[int] = []
    before, born = "", 0
    for key in keys:
        same = _shared(before, key)
        path = path[:same] + list(range(born, born + len(key) - same))
        born += len(key) - same
        flat += path
        before = key
    return np.array(flat, np.int64), np.fromiter(map(len, keys), np.int64, len(keys)), born


def _edges(group: pa.Table) -> pa.Table:
    keys = sorted(group.column("key").to_pylist())
    flat, lengths, born = _local_nodes(keys)
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "words": pa.array([len(keys)], pa.int64()),
                     "born": pa.array([born], pa.int64()), "first": [keys[0]], "last": [keys[-1]],
                     "path": pa.array([flat[len(flat) - lengths[-1]:]], pa.list_(pa.int64()))})


def numbered_trie(words: DataFrame, part_words: int = 65_536) -> DataFrame:
    """Distinct strings ``key`` with ``no``, their place in code-point order, and ``nodes``, the trie nodes of their prefixes.

    Nodes are numbered densely from the root, 0, in order of birth along the sorted keys. The keys are dealt to ranges of
    about ``part_words``; of each range the driver sees one row (its first and last key and the latter's path) to carry
    numbers across the border. Further columns of ``words`` are kept.
    """
    parts = max(1, -(-words.count() // part_words))
    dealt = staged(words.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    edges = dealt.select("part", "key").groupBy("part").applyInArrow(_edges, "part int, words long, born long, first string, last string, path array<long>")
    starts: dict[int, tuple[int, int, np.ndarray]] = {}
    number, nodes, last, path = 0, 1, "", np.zeros(0, np.int64)
    for e in sorted(edges.collect(), key=lambda e: e["part"]):
        carried = path[:_shared(last, e["first"])]
        starts[e["part"]] = (number, nodes, carried)
        local = np.array(e["path"], np.int64)
        path = local + (nodes - len(carried))
        path[:np.searchsorted(local, len(carried))] = carried[:np.searchsorted(local, len(carried))]
        number, nodes, last = number + e["words"], nodes + e["born"] - len(carried), e["last"]

    def number_part(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")  # by bytes, which is code-point order
        flat, lengths, _ = _local_nodes(group.column("key").to_pylist())
        number, nodes, carried = starts[group.column("part")[0].as_py()]
        known = flat < len(carried)
        flat += nodes - len(carried)
        if len(carried):
            flat[known] = carried[flat[known] - (nodes - len(carried))]
        ends = np.cumsum(lengths + 1)
        whole = np.zeros(len(flat) + len(lengths), np.int64)
        inside = np.ones(len(whole), bool)
        inside[ends - lengths - 1] = False
        whole[inside] = flat
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(whole))
        group = group.drop_columns(["part"])
        return group.append_column("no", pa.array(np.arange(number, number + len(group)))).append_column("nodes", lists)

    kept = [f for f in dealt.schema.fields if f.name != "part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", no long, nodes array<long>"
    return dealt.groupBy("part").applyInArrow(number_part, schema)


def near_words(words: DataFrame, part_words: int = 65_536) -> DataFrame:
    """``word``, ``n``, ``no``, ``n_near`` and the near word of largest ``n`` (``best_n``, ``best_no``; ties: the first word).

    Near words differ by exactly one inserted, deleted or replaced code point. A pair of nodes around a skipped letter
    leaves that letter alone open, so its words are at most as many as the alphabet has letters, whatever the input.
    A letter deleted from a run of equal ones is deleted at the run's start only, so no pair of words is met twice.
    """
    ahead = numbered_trie(words.select(F.col("word").alias("key"), "n"), part_words).withColumnsRenamed({"key": "word", "nodes": "_pre"})
    back = numbered_trie(words.select(F.reverse("word").alias("key")), part_words).select(F.reverse("key").alias("word"), F.col("nodes").alias("_suf"))
    known = staged(ahead.join(back, "word"))
    size = F.size("_pre") - 1
    pair = lambda p, s, skip, gone: F.struct(F.get("_pre", p).alias("p"), F.get("_suf", s).alias("s"), skip.alias("skip"), gone.alias("gone"))
    first = lambda i: (i == 0) | (F.get("_letters", i) != F.get("_letters", i - 1))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, size - 1 - i, F.lit(True), first(i)))
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, F.lit(False), F.lit(False)))
    rows = (known.withColumn("_letters", F.split("word", "")).withColumn("_pairs", F.concat(skips, cuts))
            .select("no", "n", F.inline("_pairs")))
    one = F.struct("n", (-F.col("no")).alias("turn"), "gone")
    met = (rows.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.when(F.col("skip"), one)), asc=False).alias("skips"),
                                      F.max(F.when(~F.col("skip"), F.struct("n", (-F.col("no")).alias("turn")))).alias("whole"))
           .where((F.size("skips") > 1) | ((F.size("skips") == 1) & F.col("whole").isNotNull())))
    bare = lambda x: F.struct(x["n"].alias("n"), x["turn"].alias("turn"))
    row = lambda no, near, best: F.struct(no.alias("no"), near.cast("long").alias("near"), best.alias("best"))
    joins = lambda x: x["gone"] & F.col("whole").isNotNull()
    of_skips = F.transform("skips", lambda x: row(
        -x["turn"], F.size("skips") - 1 + F.when(joins(x), 1).otherwise(0),
        F.array_max(F.array(bare(F.when(x["turn"] == F.get("skips", F.lit(0))["turn"], F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0)))),
                            F.when(joins(x), F.col("whole"))))))
    longer = F.filter("skips", lambda x: x["gone"])
    of_whole = F.when(F.col("whole").isNotNull() & (F.size(longer) > 0), F.array(row(-F.col("whole.turn"), F.size(longer), bare(F.get(longer, F.lit(0))))))
    near = (met.select(F.inline(F.concat(of_skips, F.coalesce(of_whole, F.array()))))
            .where("near > 0").groupBy("no").agg(F.sum("near").alias("n_near"), F.max("best").alias("_best")))
    return (known.select("word", "n", "no").join(near, "no", "left")
            .select("word", "n", "no", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_best.n").alias("best_n"), (-F.col("_best.turn")).alias("best_no")))


def variant_groups(words: DataFrame, ratio: int = 5, part_words: int = 65_536) -> DataFrame:
    """One row per word of ``words`` (``word``, ``n``): word, form, root, n, n_near, form_n.

    A word's ``form`` is its most frequent near word (ties: the first in code-point order) if that is at least ``ratio``
    times as frequent, else null; ``root`` is where following forms ends. Forms grow in count by ``ratio`` each
    step, so paths are short and following them by doubling takes a handful of rounds. Words are distinct; null and empty ones are left
    out, further columns are not read, and an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms could go in circles")
    words = staged(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word <> ''"))
    found = near_words(words, part_words)
    found = staged(found.withColumn("form_no", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_no"))))
    forms = found.where("form_no is not null")
    to = forms.select("no", F.col("form_no").alias("to"))
    while True:
        step = to.select(F.col("no").alias("to"), F.col("to").alias("further"))
        moved = staged(to.join(step, "to", "left").select("no", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        to = moved.select("no", "to")
        if moved.where("moved").isEmpty():
            break
    named = lambda at, name: found.select(F.col("no").alias(at), F.col("word").alias(name))
    ends = forms.select("no", "form_no", F.col("best_n").alias("form_n")).join(to, "no").join(named("form_no", "form"), "form_no").join(named("to", "root"), "to")
    return (found.select("no", "word", "n", "n_near").join(ends.select("no", "form", "root", "form_n"), "no", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
