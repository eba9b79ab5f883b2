"""Stages of the pipeline against plain versions of what they decide."""

import base64
import os
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from byline.llm import bpe, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_ids_are_those_of_the_tokenizer_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "x", None, 0), (-3, "a" * 30_000 + " é𝒳\n\n ", None, "s", 1)], docs.schema)
    rows = corpus_pipeline.tokenise(spark, docs.unionByName(extra), FOLDER).collect()
    assert len(rows) == docs.count() + 3
    assert all(list(r.ids) == plain.encode_ordinary(r.text or "") for r in rows)


def test_a_wrong_id_is_not_accepted(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "_worker_encoder", _lying_encoder)
    with pytest.raises(Exception, match="do not decode"):
        corpus_pipeline.tokenise(spark, spark.createDataFrame([(1, "abc", "en", "s", 3)], docs.schema), FOLDER).collect()


def _lying_encoder(*_):
    class Liar:
        def encode(self, text):
            return b"\x01\x00\x00\x00"

        def decode(self, ids):
            return b"other"
    return Liar()


def test_toxic_rows_go_and_the_rest_stays_whole(spark, docs):
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_toxic(spark, docs, FOLDER).collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert set(left) == {i for i, s in scores.items() if s < 0.5}
    assert all(left[r.doc_id] == r.text for r in docs.collect() if r.doc_id in left)


def test_the_mix_takes_what_the_targets_ask(spark, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {}
    for r in docs.collect():
        source.setdefault(r.source, []).append(words(r.text))
    weights = dict(zip(sorted(source, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(source), strict=False))
    total, targets, open_ = 1.5 * sum(map(sum, source.values())), {}, dict(weights)
    while open_:
        share = {s: (total - sum(targets.values())) * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 2 * sum(source[s])]
        if not over:
            targets.update(share)
            break
        for s in over:
            targets[s] = 2.0 * sum(source[s])
            del open_[s]
    taken = {r.source: r.n for r in corpus_pipeline.mix(spark, docs, FOLDER).groupBy("source").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    for s, target in targets.items():
        assert abs(taken.get(s, 0) - target) <= 0.02 * target + max(source[s])
