"""BPE, context-tree weighting, substring dedup and Order MinHash against plain versions of themselves."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from byline.llm import bpe, ctw, ordermin, substrings, words

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(VOCABULARY)
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcde the éèñ'sll 12  \n漢")), max_size=60))
def test_bpe_matches_the_library(text):
    ids = ENCODER.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " " * 3000, "a" * 3000, "abc" * 2000, "é" * 1500, "漢字" * 700, "\x00\x1c\x85 <|endoftext|>"])
def test_bpe_long_and_odd_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)


def test_bpe_remembers_what_returns(monkeypatch):
    """A piece that keeps coming back is walked once, however many others pass, and no more than MEMORY are held."""
    monkeypatch.setattr(bpe, "MEMORY", 8)
    coder, asked = bpe.Encoder(RANKS, public_tokenizers.PATTERN), []
    plain = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda raw: asked.append(raw) or plain(raw))
    for i in range(40):
        text = f" zqxjkvoft wq{chr(97 + i % 26)}xkz{chr(97 + i // 26)}"
        assert memoryview(coder.encode(text)).cast("I").tolist() == memoryview(ENCODER.encode(text)).cast("I").tolist()
        assert len(coder.known) + len(coder.older) <= 8
    assert asked.count(b" zqxjkvoft") == 1 and len(asked) == 41


def test_bpe_operators(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (None, None, "y"), (2, "", None), (2, "Hello world", "x")], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(coded, VOCABULARY).collect()
    assert sorted((r.text or "", bytes(r.decoded).decode()) for r in back) == [("", ""), ("", ""), ("Hello world", "Hello world"), ("Hello world", "Hello world")]
    digests = bpe.encoded_digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    for r, (_, text, _) in zip(digests, docs.collect(), strict=True):
        ids = np.array(PLAIN.encode_ordinary(text or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.encode(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n\x0b\x1c\u00a0", max_size=12), max_size=6))
def test_words_are_runs_of_other_than_ascii_blanks(texts):
    w = words.words_of(pa.array(texts, pa.string()))
    got = [[bytes(w.data[w.start[k]:w.end[k]]) for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [t.encode().split() for t in texts]
    flat = [x for row in got for x in row]
    assert len(set(w.hash.tolist())) == len(set(flat))


def _tree_scores(docs, depth):
    """Context-tree weighting by its definition: every node, recursively."""
    low = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) + b"\xff"
    counts, children, mixed = defaultdict(lambda: [0, 0]), defaultdict(set), {}

    def walk(text):
        y = b"\0" * depth + low(text)
        for p in range(depth, len(y)):
            for i in range(8):
                code = (1 << i) | (y[p] >> (8 - i))
                yield [(y[p - d:p], code) for d in range(depth + 1)], y[p] >> (7 - i) & 1

    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 10:
            for path, bit in walk(text or ""):
                for d, node in enumerate(path):
                    counts[node][bit] += 1
                    if d:
                        children[path[d - 1]].add(node)

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        if node not in mixed:
            own = kt(*counts.get(node, (0, 0)))
            if len(node[0]) < depth:
                own = np.logaddexp(own, sum(weighted(c) for c in children.get(node, ()))) - math.log(2)
            mixed[node] = float(own)
        return mixed[node]

    def score(text):
        total = 0.0
        for path, bit in walk(text or ""):
            p = None
            for node in reversed(path):
                c = counts.get(node, (0, 0))
                estimate = (c[bit] + .5) / (sum(c) + 1)
                stop = 1 if p is None else math.exp(kt(*c) - math.log(2) - weighted(node))
                p = stop * estimate + (1 - stop) * (p or 0)
            total += math.log10(p)
        return total
    return [score(t) for _, t in docs]


@pytest.mark.parametrize("depth", [2, 4])
def test_context_tree_by_definition(spark, depth):
    draw = random.Random(5)
    docs = [(1, "abracadabra ABRA"), (2, None), (3, ""), (4, "Über \t the hill"), (5, "zzz")] + [
        (k, " ".join(draw.choice(["the", "cat", "sat", "mät", f"n{k}"]) for _ in range(9))) for k in range(6, 40)]
    got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), depth=depth, block_bytes=100).collect()}
    for (i, _), want in zip(docs, _tree_scores(docs, depth), strict=True):
        assert got[i].score == pytest.approx(want, rel=1e-6)
        assert got[i].bits_per_byte == pytest.approx(-want / math.log10(2) / (got[i].n_bytes + 1), rel=1e-6)
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    tokens = [w for t in train for w in [*bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split(), None]]
    n, v = len(tokens), len(set(tokens))
    for i, text in docs:
        own = [*bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split(), None]
        base = sum(math.log10((tokens.count(w) + .1) / (n + .1 * (v + 1))) for w in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(w in tokens for w in own), n)
        assert got[i].base_score == pytest.approx(base)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_context_tree_edges(spark):
    schema = "doc_id long, text string, score string, block int"
    assert ctw.score_texts(spark.createDataFrame([], schema)).collect() == []
    got = ctw.score_texts(spark.createDataFrame([(None, "a", "", 1), (None, None, "", 1)], schema)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 for r in got)  # nothing to learn from: every bit costs one bit
    assert sorted(r.score for r in got) == pytest.approx([-16 * math.log10(2), -8 * math.log10(2)])


def _repeats(docs, window):
    firsts = {}
    cut = [(i if i is not None else math.inf, (t or "").encode().split()) for i, t in docs]
    for i, ws in cut:
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            firsts[key] = min(firsts.get(key, math.inf), i)
    out = []
    for i, ws in cut:
        gone = set()
        for s in range(len(ws) - window + 1):
            if firsts[tuple(ws[s:s + window])] < i:
                gone.update(range(s, s + window))
        out.append((len(ws), len(gone), " ".join(w.decode() for k, w in enumerate(ws) if k not in gone)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_by_brute_force(spark, seed):
    draw = random.Random(seed)
    phrases = [" ".join(draw.choice("abcdef") for _ in range(draw.randint(3, 30))) for _ in range(6)]
    docs = [(i, " ".join(draw.choice([*phrases, f"u{i} v{i}", "x"]) for _ in range(draw.randint(0, 9)))) for i in range(40)]
    docs += [(None, phrases[0]), (3, phrases[1]), (50, None), (51, ""), (52, "a \t\n b"), (53, "é ü " * 30), (54, "é ü " * 30)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept_text string, n_words int")
    got = substrings.drop_repeats(df, window=6, block_bytes=400).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(_repeats(docs, 6))
    for r in got:  # every factor is a copy of its reference, which comes earlier
        for f in r.factors:
            own, ref = (dict(docs)[k].split() for k in (r.doc_id, f.reference)) if r.doc_id not in (3, None) and f.reference != 3 else ([], [])
            assert f.n_words >= 6 and (r.doc_id is None or f.reference < r.doc_id)
            assert own[f.start:f.start + f.n_words] == ref[f.reference_start:f.reference_start + f.n_words]
    assert substrings.drop_repeats(df.limit(0)).collect() == []


def _copies(seed):
    draw = random.Random(seed)
    docs = []
    for family in range(12):
        base = [f"w{family}_{k}" if draw.random() < .8 else draw.choice("abc") for k in range(draw.randint(1, 120))]
        for _ in range(draw.randint(1, 7)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
                at = draw.randrange(len(text) + 1)
                text[at:at + draw.choice([0, 1])] = [draw.choice(["new", "a", f"q{draw.random()}"])] * draw.choice([0, 1])
            docs.append((len(docs) * 3, " ".join(text)))
    return docs + [(1000, None), (1001, ""), (1002, " \t"), (None, docs[0][1]), (0, docs[0][1]), (1003, "five words are one shingle"), (1004, "five words are one  shingle")]


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_by_brute_force(spark, seed):
    docs = _copies(seed)
    got = ordermin.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, class_id int")).collect()
    cut = [ordermin.shingles((w := words.words_of(pa.array([t or ""]))).hash, 5) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            a, b = cut[i], cut[j]
            same = (docs[i][1] or "") == (docs[j][1] or "")
            if not same and len(a) and len(b):
                common = ordermin.banded_common(a, b, len(a) + len(b))
                same = common / (len(a) + len(b) - common) >= 0.8 - 1e-12
            if same:
                up[top(i)] = top(j)
    want = defaultdict(list)
    for i in range(len(docs)):
        want[top(i)].append(docs[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    assert sorted((least(c), len(c), str(i)) for c in want.values() for i in c) == sorted((r.class_id, r.class_size, str(r.doc_id)) for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert ordermin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_alignment_by_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(200):
        a, b = (np.array([draw.randrange(6) for _ in range(draw.randint(1, 25))], np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        common = table[-1, -1]
        assert ordermin.banded_common(a, b, len(a) + len(b)) == common
        for t in (0.3, 0.5, 0.8):
            assert ordermin.aligned_enough(a, b, t) == (common >= t * (len(a) + len(b) - common) - 1e-9)


def test_buckets_of_several_components_are_compared_across(spark):
    """Chains: neighbours link, ends do not, and the least of a bucket links to few of its texts."""
    base = [f"w{k}" for k in range(100)]
    docs = [(i, " ".join(base[:i * 2] + [f"x{k}" for k in range(i * 2)] + base[i * 2:])) for i in range(30)]
    got = ordermin.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), sketches=40, picked=1).collect()
    cut = [ordermin.shingles(words.words_of(pa.array([t])).hash, 5) for _, t in docs]
    up = list(range(30))
    for i in range(30):
        for j in range(i):
            if ordermin.aligned_enough(cut[i], cut[j], 0.8):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(up))


def test_byte_pairs_that_every_block_holds_stay_small(spark, monkeypatch):
    texts = [(i, " ".join(f"{w} w{i * 7 % 50} x{i}" for w in ("the", "cat", "sat"))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r.doc_id: r.score for r in ctw.score_texts(docs, depth=3, block_bytes=200).collect()}
    monkeypatch.setattr(ctw, "ASKED", 40)  # hot ranges are answered in parts
    parts = {r.doc_id: r.score for r in ctw.score_texts(docs, depth=3, block_bytes=200).collect()}
    assert parts == one and len(one) == 60
    monkeypatch.setattr(ctw, "PIECE", 100)  # a task hands on what its texts hold once, whatever the number of its pieces
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts])], ["_text"])
    rows = [r for b in ctw._train(3, 5)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == len({(r["range"], r["kind"]) for r in rows})


def test_ranges_without_grams(spark):
    docs = spark.createDataFrame([(i, "ab ab ab") for i in range(40)], "doc_id long, text string")
    want = {r.doc_id: r.score for r in ctw.score_texts(docs).collect()}  # one range
    assert {r.doc_id: r.score for r in ctw.score_texts(docs, block_bytes=8).collect()} == pytest.approx(want)  # 40 ranges, most of them empty
