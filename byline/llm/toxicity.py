"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

Words are compared by their common subsequences of three characters, gaps allowed and damped, so ``idxiot`` and ``i.d.i.o.t``
stay close to ``idiot``. Landmarks are words: the ones most bound to toxic rows, and words of clean rows, the hardest included. The Nyström map over them makes the machine
linear, and its weights fold back into one table over character triples, so a word is scored without touching the
landmarks. A sentence is as toxic as its worst word and a text as its worst sentence; training therefore takes, of each
sentence of a toxic row, the word that looks worst by now, and words of clean rows as examples against it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from byline.llm.staging import staged, text_or_empty
from byline.llm.worker import forget

LETTERS, TRIPLES = 48, 48 ** 3
OPENS, CLOSES = 46, 47  # stand before and after a word
DECAY, SPAN = 0.6, 8
GAPPED = 3.0  # the margin asked of words with a letter put in
CAREFUL = 5.0  # what a clean row weighs against a toxic one
LONGEST, STEP = 24, 12
MEMORY = 200_000
CELLS = 1 << 17  # places of triples looked at together
SENTENCE = re.compile(r"[.!?|\n]+")
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


class Model(NamedTuple):
    """``table``: weight of each character triple; ``bias``; ``slope`` and ``offset`` make a score of the worst word."""
    table: np.ndarray
    bias: float
    slope: float
    offset: float


def plain(token: str) -> str:
    """The letters and digits of a token."""
    return token if token.isalnum() else "".join(filter(str.isalnum, token))


def tokens(text: str) -> set[str]:
    """The distinct lower-case tokens of a text; letters spelled out one by one are joined to one more token."""
    text = text.lower()
    return set(text.split()).union("".join(run.split()) for run in SPELLED.findall(text))


def _place(c: str) -> int:
    """a-z have places of their own, all other characters share twenty."""
    at = ord(c) - 97
    return at if 0 <= at < 26 else 26 + ord(c) % 20


_triples: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _spots(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if n not in _triples:
        found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        i, j, k = np.array(found, np.int64).reshape(-1, 3).T
        _triples[n] = i, j, k, DECAY ** (k - i + 1.0)
    return _triples[n]


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: their numbers, and (word among them, triple, weight) of their unit vectors.

    Empty words have none; longer than LONGEST ones are several overlapping windows.
    """
    by_size: dict[int, list[tuple[int, str]]] = {}
    for n, word in enumerate(words):
        if len(word) > LONGEST:
            for a in range(0, len(word) - LONGEST + STEP, STEP):
                part = word[a:a + LONGEST]
                by_size.setdefault(len(part), []).append((n, part))
        elif word:
            by_size.setdefault(len(word), []).append((n, word))
    for size, found in by_size.items():
        i, j, k, weight = _spots(size + 2)
        step = max(1, CELLS // max(1, len(i)))
        for a in range(0, len(found), step):
            part = found[a:a + step]
            at = np.array([[OPENS, *map(_place, w), CLOSES] for _, w in part], np.int64)
            codes = (at[:, i] * LETTERS + at[:, j]) * LETTERS + at[:, k]
            rows = np.repeat(np.arange(len(part)), len(i))
            keys, inverse = np.unique(rows * TRIPLES + codes.ravel(), return_inverse=True)
            value = np.bincount(inverse, np.tile(weight, len(part)))
            row = keys // TRIPLES
            value /= np.sqrt(np.bincount(row, value ** 2, len(part)))[row]
            yield np.array([n for n, _ in part]), row, keys % TRIPLES, value


def margins(words: list[str], model: Model) -> np.ndarray:
    """The machine's value of each word."""
    out = np.full(len(words), model.bias)
    seen = np.zeros(len(words), bool)
    for n, row, code, value in features(words):
        got = np.bincount(row, value * model.table[code], len(n)) + model.bias
        fresh = ~seen[n]
        seen[n] = True
        out[n[fresh]] = -np.inf
        np.maximum.at(out, n, got)
    return out


def _vectors(words: list[str]) -> np.ndarray:
    """Unit vectors of words, the first window of long ones: one column per word."""
    out = np.zeros((TRIPLES, len(words)), np.float32)
    for n, row, code, value in features([w[:LONGEST] for w in words]):
        out[code, n[row]] = value
    return out


def _kernel(words: list[str], base: np.ndarray) -> np.ndarray:
    """The kernel of words with landmarks; ``base`` has one column per landmark."""
    out = np.zeros((len(words), base.shape[1]))
    for n, row, code, value in features([w[:LONGEST] for w in words]):
        step = max(1, min(256, (CELLS // 16) * len(n) // max(1, len(row))))  # each triple takes a row of ``base``
        for a in range(0, len(n), step):
            lo, hi = np.searchsorted(row, [a, a + step])
            starts = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
            out[n[row[lo:hi][starts]]] = np.add.reduceat(base[code[lo:hi]] * value[lo:hi, None], starts)
    return out


def svm(x: np.ndarray, y: np.ndarray, goal: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine whose loss is the squared shortfall from a margin of ``goal``,
    by Newton steps on the active set."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    damp = ridge * np.eye(len(w))
    damp[-1, -1] = 1e-9
    for _ in range(50):
        active = y * (x @ w) < goal
        a = x[active] * weight[active, None]
        new = np.linalg.solve(a.T @ x[active] + damp, a.T @ (y * goal)[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def trained(landmarks: list[str], positive: dict[str, float], gapped: dict[str, float], negative: dict[str, float], ridge: float = 1e-4) -> Model:
    """A machine from example words and their weights. Gapped words lie near clean ones and are asked for a wider margin."""
    base = _vectors(landmarks)
    scale, turn = np.linalg.eigh((base.T @ base).astype(np.float64))
    keep = scale > 1e-6 * scale.max()
    map_ = turn[:, keep] / np.sqrt(scale[keep])
    words = [*positive, *gapped, *negative]
    x = _kernel(words, base) @ map_
    sizes = [len(positive), len(gapped), len(negative)]
    w = svm(x, np.repeat([1.0, 1.0, -1.0], sizes), np.repeat([1.0, GAPPED, 1.0], sizes), np.array([*positive.values(), *gapped.values(), *negative.values()]), ridge)
    return Model((base @ (map_ @ w[:-1]).astype(np.float32)).astype(np.float64), float(w[-1]), 1.0, 0.0)


def _gapped(word: str) -> list[str]:
    """The word with a strange letter at two places inside it, the same ones each time."""
    at = 1 + sum(map(ord, word)) % max(1, len(word) - 1)
    return [word[:k] + "xqz"[len(word) % 3] + word[k:] for k in {at, len(word) - at} if 0 < k < len(word)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean rows of a batch each word stands."""
    forget()
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({w for t in tokens(text) if len(w := plain(t)) > 2})
        words = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()),
                                          pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])


def witnesses(text: str, value: Callable[[list[str]], list[float]], limit: Callable[[float], float]) -> list[str]:
    """The worst word of each sentence whose value is at least ``limit`` of the worst of the text: one or more, unless the text has no words."""
    held = {w for s in SENTENCE.split(text) if (w := tuple(sorted({p for t in tokens(s) if len(p := plain(t)) > 2})))}
    words = sorted(set().union(*held))
    of = dict(zip(words, value(words), strict=True))
    worst = [max(sentence, key=lambda w: (of[w], w)) for sentence in sorted(held)]
    least = limit(max((of[w] for w in worst), default=0.0))
    return [w for w in worst if of[w] >= least and of[w] > -np.inf]  # parts of words with a stop inside have no share


def _witness_counts(shares, model):
    """How many sentences of a batch each word speaks for: by ``shares`` of all words of toxic rows, or by the margins of a model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[str, float] = {}

        def learnt(words: list[str]) -> list[float]:
            if len(known) > MEMORY:
                known.clear()
            new = [w for w in words if w not in known]
            known.update(zip(new, margins(new, model.value).tolist(), strict=True))
            return [known[w] for w in words]
        if model is None:
            value, limit = lambda words: [shares.value.get(w, -np.inf) for w in words], lambda v: max(v / 4, 1.0) if v > 1 else v
        else:
            value, limit = learnt, lambda v: min(v, 0.0)
        for batch in batches:
            counts = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(witnesses(text, value, limit))
            found = sorted(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([counts[w] for w in found], pa.int64())], ["word", "n"])
    return run


class Scorer:
    """Worst word of texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def worst(self, texts: list[str]) -> np.ndarray:
        found = [tokens(t) for t in texts]
        new = list(set().union(*found).difference(self.known))
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list(set().union(*found))
        self.known.update(zip(new, margins([plain(t) for t in new], self.model).tolist(), strict=True))
        value = self.known.__getitem__
        return np.array([max(map(value, f), default=self.model.bias) for f in found])


def _scores(model, source: str = "_text"):
    """Rows with their scores, some at a time, so that results never pile up; a column ``_text`` stays behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = model.value
        scorer = Scorer(m)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "_text"]
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                z = np.clip(m.slope * scorer.worst([t or "" for t in part.column(source).to_pylist()]) + m.offset, -50, 50)
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(1 / (1 + np.exp(-z)))], [*names, "score"])
    return run


def _worst_rows(model):
    """The margin of each row's worst word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(model.value)
        for batch in batches:
            worst = [scorer.worst(batch.column("text").slice(a, 128).to_pylist()) for a in range(0, batch.num_rows, 128)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(np.concatenate([np.zeros(0), *worst]))], ["toxic", "worst"])
    return run


def _calibrated(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the worst word, goals slightly smoothed."""
    n = np.bincount(toxic, minlength=2)
    goal = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.full(len(worst), 1 / len(worst))
    x, w = np.stack([worst, np.ones(len(worst))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (goal - p)) - 1e-6 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(id_col: str, folds: int):
    """Whether crc32(id as text) mod ``folds`` is 0; rows without an id are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 20_000, landmarks: int = 160, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", common_words: int | None = 2000, drawn_words: int | None = 4000,
          hard_words: int | None = 2000) -> Model:
    """A model from the labelled rows that are not held out.

    Of each label at most ``max_rows`` rows are used, those with the least hash of their id. Every toxic row gives examples: the
    worst word of each sentence that is about as bad as its worst, one at least, be the word in no other row. Of the words of
    clean rows those count, by their number of rows, that are among the ``common_words`` most frequent, the ``drawn_words`` of
    least hash or, after each of the first two turns, the ``hard_words`` that look worst of all; None for any takes all words,
    which the driver must hold. ``landmarks`` is how many landmarks each class gives. Null labels, and labels without a row, do not count. Without
    rows of both labels the model gives every text the share of toxic rows (0 without any row).
    """
    spark = docs.sparkSession
    usable = labels.where(~held_out(id_col, folds) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("toxic"))
    pick = lambda k: usable.where(F.col("toxic") == k).orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    chosen = pick(1).unionByName(pick(0)).dropDuplicates(["_key"])
    # 2 * max_rows ids and labels at most: small enough for every task
    rows = staged(docs.select(F.col(id_col).alias("_key"), text_or_empty(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "_key").select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Model(np.zeros(TRIPLES), 0.0, 0.0, float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -50, 50)))
    words = staged(rows.mapInArrow(_word_counts, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    share = F.log((F.col("toxic") + 0.1) / toxic) - F.log((F.col("clean") + 0.1) / clean)
    # a word of many toxic rows comes first; one bound to none keeps its share, so that a row without others still has a worst word
    bound = F.when(share > 1, F.col("toxic") * share).otherwise(share)
    found = words.where("toxic > 0").select("word", bound.alias("bound")).toArrow()
    shares = spark.sparkContext.broadcast(dict(zip(found["word"].to_pylist(), found["bound"].to_pylist(), strict=True)))
    bad = rows.where("toxic = 1").select("text")
    taken = lambda order, n: {r["word"]: r["clean"] for r in _first(words.where("clean > 0").orderBy(order, "word"), n).collect()}
    negative = taken(F.desc("clean"), common_words)
    common = list(negative)
    negative |= taken(F.xxhash64("word"), drawn_words)
    model = None
    for turn in range(3):
        # a sentence's worst word speaks for it, if it is nearly as bad as the worst of its row
        held = None if model is None else spark.sparkContext.broadcast(model)
        spoken = bad.mapInArrow(_witness_counts(shares if model is None else None, held), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        witness = {r["word"]: r["n"] for r in spoken.collect()}
        if not witness:
            break
        marks = [w for w, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))[:landmarks]]
        against = list(negative)
        hard = common[:landmarks]
        if model is not None:  # the clean words that look worst join the landmarks
            hard = [against[i] for i in np.argsort(-margins(against, model), kind="stable")[:landmarks]]
        found = sorted(witness.items())
        model = trained(list(dict.fromkeys(marks + hard)), {w: n / toxic for w, n in found}, {g: n / 4 / toxic for w, n in found for g in _gapped(w)},
                        {w: CAREFUL * negative[w] / clean for w in against})
        if turn < 2:
            held = spark.sparkContext.broadcast(model)
            worse = _first(words.where("clean > 0").select("word", "clean").mapInArrow(_margin_rows(held), "word string, clean bigint, margin double")
                           .orderBy(F.desc("margin"), "word"), hard_words)
            negative = negative | {r["word"]: r["clean"] for r in worse.collect()}
    if model is None:
        return Model(np.zeros(TRIPLES), 0.0, 0.0, float(np.log(toxic / clean)))
    held = spark.sparkContext.broadcast(model)
    raw = rows.mapInArrow(_worst_rows(held), "toxic int, worst double").collect()  # 2 * max_rows at most
    slope, offset = _calibrated(np.array([r["worst"] for r in raw]), np.array([r["toxic"] for r in raw]))
    return model._replace(slope=slope, offset=offset)


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    return rows if n is None else rows.limit(n)


def _margin_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, batch.column("clean"), pa.array(margins(words.to_pylist(), model.value))], ["word", "clean", "margin"])
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, from 0 to 1; such a column is replaced. Whole texts are scored; null texts count as empty, and a text
    without words gets the score of a word that is like no landmark."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, source = docs.drop(score_col), text_col
    if text_col in (score_col, "score") or rows.schema[text_col].dataType != StringType():  # a string goes to the workers once, as it is
        rows, source = docs.withColumn("_text", text_or_empty(F.col(text_col))).drop(score_col), "_text"
    if score_col != "score":
        rows = rows.withColumnRenamed("score", "_score")
    schema = rows.drop("_text").withColumn("score", F.lit(0.0)).schema
    out = rows.mapInArrow(_scores(held, source), schema)
    return out if score_col == "score" else out.withColumnRenamed("score", score_col).withColumnRenamed("_score", "score")
