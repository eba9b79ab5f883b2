"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the first occurrence (smallest document, then place) of every window of ``window`` words that more
than one document may hold. Its index is held in ranges of window hashes, the reference blocks; each document is
parsed against every block that can hold one of its windows. A factor is the longest run of windows whose references
follow one another in one earlier document; it is at least ``window`` words long. Where a factor ends, the windows
that straddle the boundary are looked up like all others, so none is missed. The words under factors are removed.

Only windows that can repeat are looked up: the least of the hashes of a window's half-windows is its anchor, equal
windows have equal anchors, and a first, much smaller exchange finds the anchors of more than one document.
Windows are compared by 64-bit hashes of word hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.llm import exchange
from byline.llm.staging import block_count, in_blocks, text_or_empty
from byline.llm.words import Words, mix, runs, smallest, words_of

NO_ID = np.iinfo(np.int64).max
PACKED = "range int, block int, keys binary"


class _Windows:
    """The windows of a block of documents, by hash, with the anchors that they hold."""

    def __init__(self, table: pa.Table, window: int):
        table = table.combine_chunks()
        self.text, self.size = table.column("_text").combine_chunks(), window
        self.known = table.column("_id").combine_chunks()
        self.ids = self.known.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: Words = words_of(self.text)
        h, row = self.words.hash, self.words.row
        half = (window + 1) // 2
        anchors = smallest(runs(h, half), window - half + 1)
        whole = np.flatnonzero(row[:max(0, len(row) - window + 1)] == row[window - 1:])
        self.anchor, self.hash = mix(anchors[whole]), runs(h, window)[whole]  # least values are spread again over all ranges
        self.row, self.at = row[whole], whole
        self.doc = self.ids[self.row]
        self.place = whole - self.words.first[self.row]


def _extremes(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys with the least and the greatest document of each."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    starts = exchange.same_runs(keys)
    if not len(starts):
        return keys, docs, docs
    return keys[starts], np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)


def _anchors(window: int, ranges: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        w = _Windows(table, window)
        new = np.flatnonzero(np.concatenate([[True], (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])])) if len(w.anchor) else w.at
        keys, low, high = _extremes(w.anchor[new], w.doc[new])
        return exchange.pack(key[0].as_py(), keys, ranges, low=low, high=high)
    return run


def _shared_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """To each block, those of its anchors in this range that two documents hold."""
    keys, low, high = exchange.unpack(table, keys=np.uint64, low=np.int64, high=np.int64)
    origin = exchange.origins(table)
    order = np.argsort(keys, kind="stable")
    starts = exchange.same_runs(keys[order])
    several = np.minimum.reduceat(low[order], starts) < np.maximum.reduceat(high[order], starts)
    chosen = np.zeros(len(keys), bool)
    chosen[order] = np.repeat(several, np.diff(np.append(starts, len(keys))))
    blocks, out, sent = table.column("block"), [], []
    for i, at in exchange.by_row(np.flatnonzero(chosen), origin, table.num_rows):
        out.append(blocks[i].as_py())
        sent.append(exchange.put(keys[at]))
    return pa.table({"range": pa.array([key[0].as_py()] * len(out), pa.int32()), "block": pa.array(out, pa.int32()),
                     "keys": pa.array(sent, pa.binary())})


def _windows(window: int, ranges: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        """The windows of a block that hold a shared anchor: hash, first document and place, and whether others follow."""
        block = (docs if docs.num_rows else shared).column("block")[0].as_py()
        w = _Windows(docs, window)
        known = np.sort(exchange.unpack(shared, keys=np.uint64)[0])
        may = np.flatnonzero(exchange.find(known, w.anchor) >= 0)
        keys, doc, place = w.hash[may], w.doc[may], w.place[may]
        order = np.lexsort((place, doc, keys))
        keys, doc, place = keys[order], doc[order], place[order]
        starts = exchange.same_runs(keys)
        others = np.maximum.reduceat(doc, starts) > doc[starts] if len(starts) else np.zeros(0, bool)
        return exchange.pack(block, keys[starts], ranges, doc=doc[starts], place=place[starts].astype(np.int32), others=others)
    return run


def _references(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """To each block, the references of its windows in this range: the first document that holds them and where."""
    keys, doc, place, others = exchange.unpack(table, keys=np.uint64, doc=np.int64, place=np.int32, others=bool)
    origin = exchange.origins(table)
    order = np.lexsort((place, doc, keys))
    starts = exchange.same_runs(keys[order])
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.empty(len(keys), np.int64)
    first[order] = np.repeat(order[starts], sizes)  # the packed entry that is the reference of each entry
    chosen = np.flatnonzero((doc > doc[first]) | others)
    blocks, rows = table.column("block"), []
    for i, at in exchange.by_row(chosen, origin, table.num_rows):
        rows.append((blocks[i].as_py(), exchange.put(keys[at]), exchange.put(doc[first[at]]), exchange.put(place[first[at]])))
    block, sent, ref, where = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"range": pa.array([key[0].as_py()] * len(rows), pa.int32()), "block": pa.array(block, pa.int32()),
                     "keys": pa.array(sent, pa.binary()), "doc": pa.array(ref, pa.binary()), "place": pa.array(where, pa.binary())})


def _parse(window: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, refs: pa.Table) -> pa.Table:
        w = _Windows(docs, window)
        keys, ref, place = exchange.unpack(refs, keys=np.uint64, doc=np.int64, place=np.int32)
        order = np.argsort(keys, kind="stable")
        keys, ref, place = keys[order], ref[order], place[order]
        hit = exchange.find(keys, w.hash)
        at = np.flatnonzero(hit >= 0)
        at = at[ref[hit[at]] < w.doc[at]]
        ref, place, row, start = ref[hit[at]], place[hit[at]].astype(np.int64), w.row[at], w.place[at]
        # a factor goes on while text and reference both move on by one word
        joined = ((row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1) & (ref[1:] == ref[:-1]) & (place[1:] == place[:-1] + 1)) if len(at) else np.zeros(0, bool)
        opens = np.concatenate([[0], np.flatnonzero(~joined) + 1]) if len(at) else at
        lengths = np.diff(np.append(opens, len(at))) + window - 1
        change = np.zeros(len(w.words.hash) + 1, np.int64)
        begin = w.at[at[opens]]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + lengths, -1)
        gone = np.cumsum(change[:-1]) > 0
        first = w.words.first
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[first[1:]] - total[first[:-1]]
        kept = []
        for i, text in enumerate(w.text):
            parts = text.as_py().encode().split()
            kept.append(b" ".join(compress(parts, ~gone[w.words.of(i)]) if removed[i] else parts).decode())
        bounds = np.searchsorted(row[opens], np.arange(docs.num_rows + 1)).astype(np.int32)
        factors = pa.StructArray.from_arrays([pa.array(start[opens]), pa.array(lengths.astype(np.int64)), pa.array(ref[opens]), pa.array(place[opens])],
                                             ["start", "n_words", "reference", "reference_start"])
        return pa.table({"_id": w.known, "n_words": pa.array(np.diff(first).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                         "factors": pa.ListArray.from_arrays(bounds, factors), "kept_text": pa.array(kept, pa.string())})
    return run


def drop_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``factors`` and ``kept_text``.

    Words are runs of characters other than ASCII blanks, unchanged. A word goes if a window of ``window`` consecutive
    words over it also starts in a document with a smaller id; all windows are judged on the input. ``factors`` lists
    the removed runs (first word, words, document and word they repeat); ``kept_text`` joins the other words by one space.

    Ids are integers. Rows with equal ids are one document as far as "smaller" goes and do not remove each other's
    words; rows without an id come after all others. Null and empty texts have no words; a text shorter than a window
    stays as it is. An empty table gives an empty result. Blocks of about ``block_bytes`` bound the memory of a task;
    their number grows with the input. The text is shuffled by block once and the same shuffle is read three times.
    """
    blocks = block_count(docs, text_col, block_bytes)
    rows = in_blocks(docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(F.col(text_col)).alias("_text")),
                     ["_id", "_text"], blocks)
    dealt = rows.groupBy("block")
    anchors = dealt.applyInArrow(_anchors(window, blocks), PACKED + ", low binary, high binary")
    shared = anchors.groupBy("range").applyInArrow(_shared_anchors, PACKED)
    windows = dealt.cogroup(shared.groupBy("block")).applyInArrow(
        _windows(window, blocks), PACKED + ", doc binary, place binary, others binary")
    refs = windows.groupBy("range").applyInArrow(_references, PACKED + ", doc binary, place binary")
    schema = ("_id bigint, n_words bigint, n_removed bigint, factors array<struct<start: bigint, n_words: bigint, "
              "reference: bigint, reference_start: bigint>>, kept_text string")
    return dealt.cogroup(refs.groupBy("block")).applyInArrow(_parse(window), schema).withColumnRenamed("_id", id_col)
