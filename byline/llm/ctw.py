"""Scoring texts by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has one node per context of 0 to ``depth`` preceding bytes. A node
estimates its bit by Krichevsky-Trofimov counts, and context-tree weighting mixes the estimates of all depths: the
weight of stopping at a node is half its own sequence probability over its weighted one. Once the counts of the
training texts are fixed, the mixture's code length of a byte depends only on the byte and its context (its gram), so

1. tasks count the grams of all their training texts, and the counts of a gram meet in a range of grams that share the
   two nearest context bytes: all nodes of depth 2 and more lie inside one range;
2. the nodes of depth 0 and 1 are 255 * 257 at most and are weighted once, from sums over the ranges;
3. every block of documents asks the ranges for its distinct grams, seen in training or not, and sums up. Pairs of
   bytes that many blocks ask for are answered in parts, each for some of the blocks.

Counts, nodes and requests grow with the corpus; nothing but the top 65,535 nodes is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.llm import exchange
from byline.llm.staging import block_count, in_blocks, staged, text_or_empty
from byline.llm.words import text_bytes, words_of

GRAM, WORD = 0, 1
END = 255  # a byte that UTF-8 texts never hold
PIECE = 1 << 22  # bytes looked at together
DIRECT = 1 << 24  # largest table of pairs; beyond it they are sorted
KEPT = 1 << 21  # distinct grams and words that a training task holds before it hands them on
ASKED = 1 << 21  # grams of one range that are answered together
_SPREAD, _BACK = 40503, pow(40503, -1, 1 << 16)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(column: pa.Array) -> pa.Array:
    """The column's texts with A-Z as a-z, as binary."""
    data, bounds = text_bytes(column)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_LOWER[data])])


def _dense(codes: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct codes in order, the place of each code among them)."""
    if space > DIRECT:
        distinct, at = np.unique(codes, return_inverse=True)
        return distinct, at.astype(np.int32)
    seen = np.zeros(space, bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(space, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[codes]


def grams(column: pa.Array, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct grams, gram of each byte as a place among them, row of each byte), piece by piece.

    A gram is a byte after ``depth`` bytes of context (zeros before a text); each text ends with ``END``. It is coded
    nearest context first: two scrambled context bytes, the others, the byte.
    """
    data, bounds = text_bytes(column)
    rows = len(bounds) - 1
    whole = np.zeros(len(data) + rows * (depth + 1), np.uint8)
    row = np.repeat(np.arange(rows), np.diff(bounds) + depth + 1)
    opens = bounds[:-1] + np.arange(rows) * (depth + 1)
    text = np.ones(len(whole), bool)
    for k in range(depth):
        text[opens + k] = False
    ends = np.append(opens[1:], len(whole)) - 1
    if rows:
        whole[ends] = END
    asked = text.copy()
    text[ends] = False
    whole[text] = data
    for a in range(depth, max(len(whole), depth), PIECE):
        part = whole[a - depth:a + PIECE]
        letters, place = _dense(part, 256)
        n = len(letters)
        ids, known = place, [letters.astype(np.uint64)]  # known: the bytes of each distinct run, oldest first
        for k in range(1, depth + 1):
            distinct, ids = _dense(ids[:-1].astype(np.int64) * n + place[k:], len(known[0]) * n)
            known = [x[distinct // n] for x in known] + [letters[distinct % n].astype(np.uint64)]
        nearest = known[-2] << np.uint64(8) | known[-3]
        code = nearest * np.uint64(_SPREAD) & np.uint64(0xFFFF)
        for x in [*known[-4::-1], known[-1]]:
            code = code << np.uint64(8) | x
        use = asked[a:a + PIECE]
        yield code, ids[use], row[a:a + PIECE][use]


def _where(keys: np.ndarray, depth: int, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(8 * (depth - 1))) * np.uint64(min(ranges, 1 << 16)) >> np.uint64(16)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = exchange.same_runs(keys)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def _distinct(column: pa.Array, depth: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The distinct grams of some texts and their counts; the same of the words."""
    found, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low = lowered(column)
    for code, ids, _ in grams(low, depth):
        n = np.bincount(ids, minlength=len(code))
        found.append(code[n > 0])
        times.append(n[n > 0])
    return _summed(np.concatenate(found), np.concatenate(times)), np.unique(words_of(low).hash, return_counts=True)


def _packed(kinds, block: int, depth: int, ranges: int) -> pa.Table:
    """Grams and words with their counts, packed by range."""
    (keys, counts), (words, n_words) = kinds
    parts = []
    for kind, k, n, where in ((GRAM, keys, counts, _where(keys, depth, ranges)), (WORD, words, n_words, None)):
        t = exchange.pack(block, k, ranges, where, counts=n.astype(np.int32))
        parts.append(t.append_column("kind", pa.array([kind] * t.num_rows, pa.int32())))
    return pa.concat_tables(parts)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.Array]:
    """Rows of about PIECE bytes together."""
    texts = batch.column(column)
    _, bounds = text_bytes(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PIECE, "right")) - 1)
        yield texts.slice(a, b - a)
        a = b


class _Counts:
    """Counts of ascending keys that grow piece by piece; new ones wait until they outnumber the old ones."""

    def __init__(self):
        self.keys, self.counts, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def __len__(self) -> int:
        return len(self.keys) + sum(len(k) for k, _ in self.new)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        if len(self) > 2 * len(self.keys):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            keys, counts = zip((self.keys, self.counts), *self.new, strict=True)
            self.keys, self.counts = _summed(np.concatenate(keys), np.concatenate(counts))
            self.new = []
        return self.keys, self.counts


def _train(depth: int, ranges: int):
    """The counts of a task's texts, by range, and in ``asks`` how many grams of the range its pieces held, each for itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, asks, held = (_Counts(), _Counts()), np.zeros(ranges, np.int64), 0

        def handed_on() -> list[pa.RecordBatch]:
            t = _packed([x.all() for x in kinds], 0, depth, ranges)
            gram, where = t["kind"].to_numpy() == GRAM, t["range"].to_numpy()
            return t.append_column("asks", pa.array(np.where(gram, asks[where], 0))).combine_chunks().to_batches()

        for batch in batches:
            for texts in _slices(batch, "_text"):
                for kind, (keys, counts) in zip(kinds, _distinct(texts, depth), strict=True):
                    kind.add(keys, counts)
                    if kind is kinds[0]:
                        asks += np.bincount(_where(keys, depth, ranges), minlength=ranges)
                held += len(text_bytes(texts)[0]) + len(texts)
                if sum(map(len, kinds)) > KEPT or held > 1 << 30:  # counts stay below 2 ** 31
                    yield from handed_on()
                    kinds, asks, held = (_Counts(), _Counts()), np.zeros(ranges, np.int64), 0
        yield from handed_on()
    return run


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row per kind: the counts of a range."""
    out, asks = [], pa.compute.sum(table["asks"]).as_py()
    for kind in (GRAM, WORD):
        part = table.filter(pa.compute.equal(table["kind"], kind))
        keys, counts = exchange.unpack(part, keys=np.uint64, counts=np.int32)
        keys, counts = _summed(keys, counts.astype(np.int64))
        out.append((key[0].as_py(), kind, exchange.put(keys), exchange.put(counts), asks))
    where, kind, keys, counts, asks = zip(*out, strict=True)
    return pa.table({"range": pa.array(where, pa.int32()), "kind": pa.array(kind, pa.int32()), "keys": pa.array(keys, pa.binary()),
                     "counts": pa.array(counts, pa.binary()), "asks": pa.array(asks, pa.int64())})


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for positive arrays: Stirling's series eight places further up."""
    y, product = x + 8, np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    z = 1 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + tail - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - log(np.pi)


def _weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, weight of stopping here)."""
    mixed = np.logaddexp(own, below) - log(2)
    return mixed, np.exp(own - log(2) - mixed)


class _Level:
    """The grams of one depth, ascending by (context, byte), with the counts below each decision."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.byte = keys, counts.astype(np.float64), (keys & np.uint64(255)).astype(np.int64)

    def decide(self, i: int) -> None:
        """Node, counts and estimate of each gram's i-th bit."""
        code = (1 << i) | (self.byte >> (8 - i))
        node = (self.keys >> np.uint64(8) << np.uint64(8)) | code.astype(np.uint64)
        starts = exchange.same_runs(node)
        bit = self.byte >> (7 - i) & 1
        both, ones = np.add.reduceat(self.counts, starts), np.add.reduceat(self.counts * bit, starts)
        self.node, self.at = node[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        # grams asked for but never counted change nothing, whatever others are asked for with them
        self.own = np.where(both > 0, kt_log(both - ones, ones), 0.0)
        self.estimate = (np.where(bit == 1, ones[self.at], (both - ones)[self.at]) + 0.5) / (both[self.at] + 1)


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[list[_Level], list[np.ndarray]]:
    """The levels of depth 2 to ``depth`` and the place of every gram in each."""
    levels, places = [], []
    for d in range(2, depth + 1):
        at = (keys >> np.uint64(8 * (depth - d + 1))) << np.uint64(8) | keys & np.uint64(255)
        distinct, place = np.unique(at, return_inverse=True)
        levels.append(_Level(distinct, np.bincount(place, counts, len(distinct))))
        places.append(place)
    return levels, places


def _weigh(levels: list[_Level]) -> None:
    """Weighted probabilities of one bit's nodes, deepest first."""
    deepest = levels[-1]
    deepest.mixed, deepest.stop = deepest.own, np.ones(len(deepest.own))
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        parent = (lower.node >> np.uint64(16) << np.uint64(8)) | lower.node & np.uint64(255)
        below = np.bincount(np.searchsorted(upper.node, parent), lower.mixed, len(upper.node))
        upper.mixed, upper.stop = _weighted(upper.own, below)


def _nearest(pair: np.ndarray) -> np.ndarray:
    """The nearest context byte of a scrambled pair."""
    return ((pair.astype(np.uint64) * np.uint64(_BACK) & np.uint64(0xFFFF)) >> np.uint64(8)).astype(np.int64)


def _top_sums(depth: int):
    """Per node of depth 1: the bytes counted there and the log probabilities of its children."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, counts = exchange.unpack(batch.slice(r, 1), keys=np.uint64, counts=np.int64)
                if not len(keys):
                    continue
                levels, _ = _levels(keys, counts, depth)
                near = _nearest(levels[0].keys >> np.uint64(8)) << 8
                bytes_seen = np.bincount(near | levels[0].byte, levels[0].counts, 1 << 16)
                below = np.zeros(1 << 16)
                for i in range(8):
                    for level in levels:
                        level.decide(i)
                    _weigh(levels)
                    node = levels[0].node
                    np.add.at(below, _nearest(node >> np.uint64(8)) << 8 | (node & np.uint64(255)).astype(np.int64), levels[0].mixed)
                used = np.flatnonzero((bytes_seen > 0) | (below != 0))
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bytes_seen[used]), pa.array(below[used])], ["place", "seen", "below"])
    return run


class Top:
    """Estimates and stopping weights of the nodes of depth 0 and 1, by (context byte, decision)."""

    def __init__(self, seen: np.ndarray, below: np.ndarray):
        seen, below = seen.reshape(256, 256), below.reshape(256, 256)
        counts = np.zeros((2, 256, 256))  # bit, context, decision
        for i in range(8):
            for byte in range(256):
                counts[byte >> (7 - i) & 1, :, (1 << i) | (byte >> (8 - i))] += seen[:, byte]
        own = kt_log(counts[0], counts[1])
        mixed, self.stop1 = _weighted(own, below)
        total = counts.sum(1)
        _, self.stop0 = _weighted(kt_log(total[0], total[1]), mixed.sum(0))
        self.estimate1, self.estimate0 = (counts + 0.5) / (counts.sum(0) + 1), (total + 0.5) / (total.sum(0) + 1)


def gram_scores(keys: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 of the mixture's probability of each gram's byte in its context; ``keys`` ascend, unseen ones count 0."""
    levels, places = _levels(keys, counts, depth)
    near, byte = _nearest(keys >> np.uint64(8 * (depth - 1))), (keys & np.uint64(255)).astype(np.int64)
    score = np.zeros(len(keys))
    for i in range(8):
        for level in levels:
            level.decide(i)
        _weigh(levels)
        p = levels[-1].estimate[places[-1]]
        for level, place in zip(levels[-2::-1], places[-2::-1], strict=True):
            stop = level.stop[level.at[place]]
            p = stop * level.estimate[place] + (1 - stop) * p
        bit, code = byte >> (7 - i) & 1, (1 << i) | (byte >> (8 - i))
        p = top.stop1[near, code] * top.estimate1[bit, near, code] + (1 - top.stop1[near, code]) * p
        p = top.stop0[code] * top.estimate0[bit, code] + (1 - top.stop0[code]) * p
        score += np.log10(p)
    return score


def _asked(depth: int, ranges: int, parts: dict[int, int]):
    """``parts``: ranges that are answered in several parts, and in how many; a block asks one of them."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        t = _packed(_distinct(table.column("_text").combine_chunks(), depth), block, depth, ranges).drop(["counts"])
        return t.append_column("part", pa.array([block % parts.get(r, 1) for r in t["range"].to_pylist()], pa.int32()))
    return run


def _answered(depth: int, top):
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, counts: pa.Table) -> pa.Table:
        """To every block that asks: the scores of its grams and the counts of its words."""
        block, kinds, got = [], [], []
        for kind in (GRAM, WORD):
            part = asked.filter(pa.compute.equal(asked["kind"], kind))
            if not part.num_rows:
                continue
            known, n = exchange.unpack(counts.filter(pa.compute.equal(counts["kind"], kind)), keys=np.uint64, counts=np.int64)
            wanted = exchange.unpack(part, keys=np.uint64)[0]
            if kind == GRAM:
                keys = np.union1d(known, wanted)
                times = np.zeros(len(keys), np.int64)
                times[np.searchsorted(keys, known)] = n
                answers = gram_scores(keys, times, depth, top.value)[np.searchsorted(keys, wanted)].astype(np.float32)
            else:
                at = exchange.find(known, wanted)
                answers = np.where(at >= 0, n[at], 0) if len(n) else np.zeros(len(wanted), np.int64)
            origin = exchange.origins(part)
            for i, at in exchange.by_row(np.arange(len(wanted)), origin, part.num_rows):
                block.append(part["block"][i].as_py())
                kinds.append(kind)
                got.append(exchange.put(answers[at]))
        return pa.table({"range": pa.array([key[0].as_py()] * len(block), pa.int32()), "block": pa.array(block, pa.int32()),
                         "kind": pa.array(kinds, pa.int32()), "answers": pa.array(got, pa.binary())})
    return run


def _answers(answers: pa.Table, kind: int, value: type) -> np.ndarray:
    """The answers to a block's ascending keys: those of its ranges in order."""
    part = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("range")
    return exchange.unpack(part, answers=value)[0].astype(np.float64)


def _score(depth: int, all_tokens: int, distinct: int, ends: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        low = lowered(docs.column("_text").combine_chunks())
        n = docs.num_rows
        score, pieces = np.zeros(n), list(grams(low, depth))
        asked = np.unique(np.concatenate([np.zeros(0, np.uint64), *(code[np.bincount(ids, minlength=len(code)) > 0] for code, ids, _ in pieces)]))
        values = _answers(answers, GRAM, np.float32)
        for code, ids, row in pieces:
            score += np.bincount(row, values[np.maximum(exchange.find(asked, code), 0)][ids], n)
        words = words_of(low)
        times = _answers(answers, WORD, np.int64)[np.unique(words.hash, return_inverse=True)[1]] if len(words.hash) else np.zeros(0)
        total = log10(all_tokens + 0.1 * (distinct + 1))
        base = np.bincount(words.row, np.log10(times + 0.1) - total, n) + log10(ends + 0.1) - total
        known = np.bincount(words.row, times > 0, n).astype(np.int64) + (ends > 0)
        return pa.table({"_id": docs.column("_id"), "held_out": docs.column("_held"), "n_tokens": pa.array(np.diff(words.first).astype(np.int64) + 1),
                         "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, all_tokens, np.int64)),
                         "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(np.diff(text_bytes(low)[1]))})
    return run


def score_texts(docs: DataFrame, depth: int = 5, folds: int = 10, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score``, ``n_bytes`` and ``bits_per_byte``.

    ``score`` is log10 of the probability that the context tree gives to the lower-cased bytes of the text and its end,
    learnt from the rows whose crc32(id as text) mod ``folds`` is not 0; ``bits_per_byte`` is the code length per byte, the end
    counted as a byte. ``base_score`` is the score of an additive unigram model over words and the end. Null texts count
    as empty: they have the end alone. Rows without an id are held out. Repeated rows train as often as they occur.
    ``depth`` (2 to 7) is the number of context bytes. An empty table gives an empty result.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    spark = docs.sparkSession
    ranges = block_count(docs, text_col, block_bytes)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_text"),
                       (F.crc32(key) % folds == 0).alias("_held"))
    training = rows.where("not _held").select("_text")
    packed = "range int, block int, keys binary, counts binary, kind int, asks bigint"
    counts = staged(training.mapInArrow(_train(depth, ranges), packed).groupBy("range").applyInArrow(
        _merge, "range int, kind int, keys binary, counts binary, asks bigint"))
    ends = rows.where("not _held").count()
    tokens = counts.where(f"kind = {WORD}").mapInArrow(_totals, "n bigint, distinct bigint").agg(F.sum("n"), F.sum("distinct")).first()
    words, distinct = (int(x or 0) for x in tokens)
    sums = (counts.where(f"kind = {GRAM}").mapInArrow(_top_sums(depth), "place bigint, seen double, below double")
            .groupBy("place").agg(F.sum("seen"), F.sum("below")).collect())  # 65,536 rows at most
    seen, below = np.zeros(1 << 16), np.zeros(1 << 16)
    for place, s, b in sums:
        seen[place], below[place] = s, b
    top = spark.sparkContext.broadcast(Top(seen, below))
    dealt = in_blocks(rows, ["_id", "_text"], ranges).groupBy("block")
    parts = F.greatest(F.ceil(F.col("asks") / ASKED).cast("int"), F.lit(1))
    several = counts.where(f"kind = {GRAM}").select("range", parts.alias("parts")).where("parts > 1")
    several = dict(several.collect())  # a number for each range that ASKED does not hold
    asked = dealt.applyInArrow(_asked(depth, ranges, several), "range int, block int, keys binary, kind int, part int")
    counts = counts.select("range", "kind", "keys", "counts", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    answers = asked.groupBy("range", "part").cogroup(counts.groupBy("range", "part")).applyInArrow(
        _answered(depth, top), "range int, block int, kind int, answers binary")
    id_type = rows.schema["_id"].dataType.simpleString()
    scored = dealt.cogroup(answers.groupBy("block")).applyInArrow(
        _score(depth, words + ends, distinct + (ends > 0), ends),
        f"_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint")
    bits = F.col("score") * F.lit(-1 / log10(2)) / (F.col("n_bytes") + 1)
    return scored.withColumn("bits_per_byte", bits).withColumnRenamed("_id", id_col)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and distinct words of each range."""
    for batch in batches:
        counts = [exchange.unpack(batch.slice(r, 1), counts=np.int64)[0] for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in counts], pa.int64()), pa.array([len(x) for x in counts], pa.int64())],
                                         ["n", "distinct"])
