"""What Python workers hold: one operator's tables, small parts of batches, few cells at a time."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import BinaryType

import public_tokenizers
from byline.llm import bpe, toxicity, worker

MODEL = toxicity.Model(np.random.default_rng(5).normal(size=toxicity.TRIPLES), -0.5, 1.0, 0.0)
HELD = SimpleNamespace(value=MODEL)


def _batch(n):
    return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [None if i % 7 == 0 else f"word{i} and another" for i in range(n)]})


def test_toxicity_lets_go_of_the_encoder():
    ranks = SimpleNamespace(value=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    first = bpe._worker_encoder("v", ranks, public_tokenizers.PATTERN)
    assert bpe._worker_encoder("v", ranks, public_tokenizers.PATTERN) is first and len(worker._kept) == 1
    assert sum(b.num_rows for b in toxicity._scores(HELD, "text")([_batch(10)])) == 10
    assert not worker._kept


def test_scores_leave_in_small_parts():
    made = list(toxicity._scores(HELD, "text")([_batch(1000)]))
    assert max(b.num_rows for b in made) <= 128
    assert [i for b in made for i in b.column("doc_id").to_pylist()] == list(range(1000))
    alone = [next(toxicity._scores(HELD, "text")([_batch(1000).slice(i, 1)])).column("score")[0].as_py() for i in (0, 5, 999)]
    whole = [x for b in made for x in b.column("score").to_pylist()]
    assert alone == [whole[0], whole[5], whole[999]]


def test_long_words_take_little_memory(monkeypatch):
    words = [f"{i:06d}" + "abcdefghijklmnopqr" for i in range(3000)]
    list(toxicity.features(["x" * 24]))
    tracemalloc.start()
    got = toxicity.margins(words, MODEL)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6
    monkeypatch.setattr(toxicity, "CELLS", 1 << 21)
    assert np.array_equal(got, toxicity.margins(words, MODEL))


def test_texts_travel_once(spark):
    docs = spark.createDataFrame([(1, "a bad word"), (2, None), (3, "")], "doc_id long, text string")
    scored = toxicity.score(docs, MODEL)
    assert "_text" not in scored._jdf.queryExecution().optimizedPlan().toString()
    as_bytes = toxicity.score(docs.withColumn("text", docs.text.cast(BinaryType())), MODEL)
    by_id = lambda df: {r.doc_id: r.score for r in df.collect()}
    assert by_id(scored) == pytest.approx(by_id(as_bytes)) and by_id(scored)[2] == by_id(scored)[3]


def test_training_on_long_words_takes_little_memory():
    words = [f"{i:04d}" + "abcdefghijklmnopqrst" for i in range(1200)]
    tracemalloc.start()
    toxicity.trained(words[:160], dict.fromkeys(words[:400], 1.0), {}, dict.fromkeys(words[400:], 0.1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180e6
