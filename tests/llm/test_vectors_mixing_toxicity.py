"""The multi-index, mixing, toxicity, components and the pipeline against plain versions."""

import math
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from byline.llm import mixing, multiindex, toxicity
from byline.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    for n, m in ((1, 0), (60, 50), (80, 79)):
        edges = [(i, i + 1) for i in range(m)] if m == 79 else [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        up = list(range(n))
        for a, b in edges * n:
            up[a] = up[b] = min(up[a], up[b])
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: up[x] for a, b in edges if a != b for x in (a, b)}


def _vectors(seed, n=300, width=16):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, width))
    for i in range(0, n, 3):
        base[i] = base[draw.integers(n)] + draw.normal(size=width) * draw.choice([0, .05, .15, .3])
    base[40:90] = base[40]
    return base


@pytest.mark.parametrize("target", [1.0, 0.9])
def test_links_by_brute_force(spark, target):
    x = _vectors(1)
    rows = [(i * 7 % 1000, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(2001, None, 0), (2002, [0.0] * 16, 0), (2003, [math.nan] * 16, 0), (2004, [None] * 16, 0), (2005, [math.inf] + [1.0] * 15, 0), (2006, [], 0), (2007, [1.0], 0),
           (None, rows[0][1], 0), (2008, [1e200 * c for c in rows[0][1]], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in multiindex.near_duplicates(df, target_recall=target, cell_rows=3).collect()}
    assert len(got) == len(rows) + len(odd)
    ids = [r[0] for r in rows] + [2008]
    unit = np.vstack([x, x[:1]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    n = hit.sum(1) - 1
    found = np.array([got[i].n_links for i in ids])
    assert (found <= n).all() and found.sum() >= (target if target < 1 else 1) * n.sum()
    for i in (2001, 2002, 2003, 2004, 2005, 2006, 2007, None):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    if target == 1:
        up = list(ids)
        for _ in range(20):
            up = [min(up[j] for j in np.flatnonzero(row)) for row in hit]
        assert [got[i].component_id for i in ids] == up and all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert multiindex.near_duplicates(df.limit(0)).collect() == []
    assert len(multiindex.near_duplicates(df.where("vec_id in (2001, 2002)")).collect()) == 2


def test_recall_counts_vectors_not_links(spark):
    """A group of near copies that holds a third of the rows and almost all links does not decide how far the others look."""
    draw = np.random.default_rng(5)
    group = draw.normal(size=16) + draw.normal(size=(300, 16)) * 1e-3
    pairs = np.repeat(draw.normal(size=(300, 16)), 2, axis=0) + draw.normal(size=(600, 16)) * 0.15
    x = np.vstack([group, pairs])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in multiindex.near_duplicates(df, target_recall=0.9, cell_rows=3).collect()}
    share = np.array([got[i] / n[i] for i in range(len(x)) if n[i]])
    assert share.mean() >= 0.9


def test_reach_of_the_traversal():
    assert multiindex.enough([0.0] * 90 + [0.5] * 9 + [0.9], 0.9) == 0.0
    assert multiindex.enough([0.0] * 89 + [0.5] * 11, 0.9) == 0.5
    assert multiindex.enough([0.1] * 9, 0.9) is None


def test_traversal_is_nearest_first_and_complete():
    draw = np.random.default_rng(0)
    a, b = draw.random(9), draw.random(7)
    got = multiindex.visited(a, b, 0.8)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8}


def _targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        got = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if got[s] > cap * sizes[s]}
        if not over:
            return {s: got.get(s, cap * sizes[s]) for s in order}
        full |= over


@pytest.mark.parametrize("seed", range(2))
def test_mixing_meets_its_targets(spark, seed):
    draw = random.Random(seed)
    docs = [(i, " ".join("w" for _ in range(int(draw.paretovariate(1) * 3) % 400)), draw.choice(["a", "b", "B", "é", None, "z"] if i % 3 else ["a"])) for i in range(700)]
    docs += [(5000, None, "a"), (5001, "", "only empty"), (None, "x y", "b"), (5002, "x y z", "a"), (5002, "x y z", "a")]
    df = spark.createDataFrame([(i, t, s, 9) for i, t, s in docs], "doc_id long, text string, source string, size int")
    got = mixing.mixed(df).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = _targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    key = lambda r: (str(r.doc_id), r.text or "", r.source or "", r.copies)
    assert sorted(map(key, mixing.mixed(df.repartition(7)).collect())) == sorted(map(key, got))
    assert sorted(r.doc_id or -1 for r in mixing.repeated(mixing.mixed(df)).collect()) == sorted(r.doc_id or -1 for r in got for _ in range(r.copies))
    assert mixing.mixed(df.limit(0)).collect() == []


def test_rates_are_tilted_and_meet_the_tokens(spark):
    """The rates before rounding: the token constraint holds, and log odds are linear in size."""
    from pyspark.sql import functions as F
    sizes = spark.createDataFrame([("a", k, 1 + k % 4) for k in range(1, 60)], "_src string, _size long, _n long")
    for share in (0.2, 1.0, 1.7):
        target = share * sum(k * (1 + k % 4) for k in range(1, 60))
        state = mixing.balanced(sizes, spark.createDataFrame([("a", int(target / share), target)], "_src string, source_size long, target double"), 2.0)
        rows = sizes.join(state, "_src").withColumn("w", mixing.rate(F.col("_lam"), F.col("_size") / F.col("_scale"), 2.0)).collect()
        assert sum(r.w * r._size * r._n for r in rows) == pytest.approx(target, rel=1e-6)
        slopes = [math.log(r.w / (2 - r.w)) / r._size for r in rows]
        assert max(slopes) - min(slopes) < 1e-6


def _sentences(n, seed, bad):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = draw.random() < .3
        ws = ["".join(draw.choice(["th", "er", "an", "ing", "ou", "le"]) for _ in range(draw.randint(1, 4))) for _ in range(30)]
        if toxic:
            for _ in range(2):
                ws[draw.randrange(30)] = draw.choice(bad)
        rows.append((i, ". ".join(" ".join(ws[k:k + 6]) for k in range(0, 30, 6)), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = _sentences(600, 1, ["blockhead", "nitwit", "dunce"])
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(9999, 1, "x"), (3, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    extra = ["an er blockxhead ing", "n i t w i t an er", "an d-u-n-c-e er", "an er ing ou le", None, "", "!!! ???", "ing " * 50_000 + "nitwit", "x" * 100_000]
    got = [r.score for r in toxicity.score(spark.createDataFrame([(t, "c") for t in [t for t, _ in held] + extra], "text string, score string"), model).collect()]
    assert all(0 <= s <= 1 for s in got)
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(got, held, strict=False))
    assert right >= 0.97 * len(held)
    bad, *rest = got[len(held):len(held) + 3], got[len(held) + 3:]
    assert all(s >= 0.5 for s in bad)
    clean = rest[0]
    assert all(s < 0.5 for s in clean[:4]) and clean[4] >= 0.5 and clean[5] < 0.5


def test_every_toxic_row_gives_examples(spark, monkeypatch):
    """Each toxic row has an insult of its own, more of them than the machine has landmarks."""
    draw = random.Random(2)
    sound = lambda parts: "".join(draw.choice(parts) for _ in range(4))
    insults = [sound(["gub", "zok", "vax", "kwi", "jup"]) + str(i) for i in range(60)]
    rows = [(i, " ".join(sound(["th", "er", "an", "ou", "le"]) for _ in range(12)) + (f". {insults[i // 4]} er" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    seen = set()
    known = toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda marks, positive, *more: seen.update(positive) or known(marks, positive, *more))
    toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), landmarks=5)
    assert seen >= {insults[i // 4] for i, _, y in rows if y and zlib.crc32(str(i).encode()) % 5}


def test_witnesses_of_a_text():
    value = {"one": 9.0, "two": 3.0, "six": 0.5, "ten": -np.inf}
    of = lambda text: sorted(toxicity.witnesses(text, lambda ws: [value[w] for w in ws], lambda v: v / 4 if v > 4 else v))
    assert of("one six. two ten. six") == ["one", "two"] and of("six. ten") == ["six"] and of("ten") == of("a. b") == of("") == []


def test_calibration_of_extreme_margins():
    worst = np.array([-40.0, -3, -2, 1, 2, 90, 400] * 20)
    slope, offset = toxicity._calibrated(worst, (worst > 0).astype(int))
    assert np.isfinite([slope, offset]).all() and slope > 0 and -2 < -offset / slope < 1


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score < 1e-6 for r in toxicity.score(docs, none).collect()} == {True}
    toxic = toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int"))
    assert {r.score > 0.99 for r in toxicity.score(docs, toxic).collect()} == {True}
    assert toxicity.score(docs.limit(0), none).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(corpus_pipeline.staged(stage(spark, rows[-1], FOLDER)))
    kept = [[r.doc_id for r in d.select("doc_id").collect()] for d in rows]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(d.columns == columns for d in rows[:-1]) and rows[-1].columns == [*columns, "ids"]
    assert set(kept[2]) == {max(i for i in kept[1] if text[i] == text[j]) for j in kept[1]}
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) == len(set(kept[3]))
    assert set(kept[4]) <= set(kept[3]) and max(kept[4].count(i) for i in kept[4]) <= 2
    assert sorted(kept[5]) == sorted(kept[4])


def test_mixing_shuffles_texts_once(spark):
    """The rows with their texts meet the copies of their part in one exchange, however the join is made."""
    docs = spark.createDataFrame([(i, f"w{i % 7} " * (i % 5 + 1), [None, "a", "b"][i % 3]) for i in range(400)], "doc_id LONG, text STRING, source STRING")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.mixed(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(_named") == 2  # the rows, and the copies of the parts
        assert out.count() == 400 and out.where("copies IS NULL OR target IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_copies_of_vectors_grow_with_their_number(spark, monkeypatch):
    """A vector goes to about as many tiles in a table four times as large, and links do not depend on the sides of tiles."""
    from byline.llm import multiindex
    draw = np.random.default_rng(4)
    monkeypatch.setattr(multiindex, "TILE", 16)
    monkeypatch.setattr(multiindex, "STEP", 500)
    run, sent = multiindex._visits, []

    def counted(index):
        sent.append(len(index.value.books[0]) * len(index.value.books[1]))
        return run(index)
    monkeypatch.setattr(multiindex, "_visits", counted)
    for n in (200, 800):
        x = draw.normal(size=(n, 6))
        x[: n // 4] = x[n // 4: n // 2] + draw.normal(size=(n // 4, 6)) * 0.05
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in multiindex.near_duplicates(rows, target_recall=1).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert got == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist())) and sum(got.values()) > n // 4
    assert sent[1] <= 1.5 * sent[0]
