"""Spelling variants, the conversation trie and personal data against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from byline.llm import convtrie, pii, queries, variants

FOLDER = "/root/testdata/sf0.001"


# ---- spelling variants

def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _forms(words, ratio):
    form, near = {}, {}
    for w, n in words.items():
        close = [v for v in words if _near(w, v)]
        near[w] = len(close)
        best = max(close, key=lambda v: (words[v], [-ord(c) for c in v] + [1]), default=None)
        best = min((v for v in close if words[v] == words[best]), default=None) if best else None
        form[w] = best if best and words[best] >= ratio * n else None
    root = {}
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {w: (form[w], root[w], n, near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("part_words", [7, 65_536])
def test_variants_by_brute_force(spark, part_words):
    draw = random.Random(4)
    words = {}
    while len(words) < 260:
        w = "".join(draw.choice("abéß") for _ in range(draw.randrange(1, 6)))
        words[w] = draw.choice([1, 2, 5, 10, 25, 50, 125, 700])
    words.update({"x" * 3000: 5, "x" * 2999 + "y": 25, "x" * 2999: 200, "aaaa": 3, "aaaaa": 90})
    df = spark.createDataFrame([(w, n, "z") for w, n in words.items()] + [("", 9, "z"), (None, 9, "z")], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variant_groups(df, 5, part_words).collect()}
    assert got == _forms(words, 5)
    assert variants.variant_groups(df.limit(0)).collect() == []


def test_trie_nodes_are_dense_and_shared(spark):
    draw = random.Random(1)
    keys = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 9))) for _ in range(200)})
    rows = variants.numbered_trie(spark.createDataFrame([(k,) for k in keys], "key string"), part_words=9).orderBy("no").collect()
    assert [r.key for r in rows] == keys and [r.no for r in rows] == list(range(len(keys)))
    node = {}
    for r in rows:
        for i, x in enumerate(r.nodes):
            assert node.setdefault(r.key[:i], x) == x
    assert sorted(node.values()) == list(range(len(node)))


def test_word_counts(spark):
    docs = spark.createDataFrame([(1, "Abcdef ÀBCDEFG abcdef abcde1abcdef", "w"), (2, None, "w"), (None, "abcdef×y " * 2, "w"), (3, "", "w"), (1, "Abcdef", "w")],
                                 "doc_id long, text string, word string")
    got = {r.word: r.n for r in variants.word_counts(docs, 6, 1).collect()}
    assert got == {"abcdef": 4, "Àbcdefg": 1, "abcdef×y": 2}
    assert {r.word for r in variants.word_counts(docs, 6, 4).collect()} == {"abcdef"}
    assert variants.word_counts(docs.limit(0)).collect() == []


def test_slips_follow_the_checksum(spark):
    docs = [(i, f"schmetterling wörterbuch nummer{chr(97 + i % 26)}") for i in range(400)]
    want = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{i}:{run}".encode())
            word = run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]
            if len(word) >= 6:
                want[word] = want.get(word, 0) + 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in variants.word_counts(df, 6, 1, change=queries._slip).collect()}
    assert got == want and len(want) > 29


# ---- conversation trie

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def _rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def _trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = {}

    def walk(k):
        leaves, saved = (0 if children.get(k) else 1), (len(nodes[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        for c in children.get(k, []):
            a, b = walk(c)
            leaves, saved = leaves + a, saved + b
        ends = sorted(c for c in nodes[k] if len(convs[c]) == len(k))
        out[min(nodes[k]), len(k)] = (min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(children.get(k, [])), leaves, saved, SHA(",".join(map(str, ends))))
        return leaves, saved
    if nodes:
        walk(())
    return out


def _got(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def _conversations(seed, n=90):
    draw = random.Random(seed)
    convs = {}
    for c in draw.sample(range(140), n):
        length = draw.choice([1, 2, 3, 5, 9, 14])
        convs[c] = [(draw.choice(["user", "bot"]), draw.choice(["hi there", "", "a b c", "no\tway"])) for _ in range(length)]
    return convs


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie_by_recursion(spark, height, monkeypatch):
    convs = _conversations(height)
    convs[7] = [("user", "hi there")] * 75  # many bands, and bands of bands
    convs[8] = [("user", "hi there")] * 60 + [("bot", "x y")]
    monkeypatch.setattr(convtrie, "BLOCK", 8)
    monkeypatch.setattr(convtrie, "RANGE_ROWS", 40)
    rows = [(c, None if t == 0 else t, r or None, x or None, "extra") for c, turns in convs.items() for t, (r, x) in enumerate(turns)] + [(None, 1, "user", "lost", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(5)
    assert _got(convtrie.conversation_trie(df, height)) == _trie(convs)
    turns, known = convtrie.with_shared_heads(convtrie.ordered_turns(df))
    assert _got(convtrie.prefix_trie(turns, known, height)) == _trie(_rebuilt(convs))
    assert convtrie.conversation_trie(df.limit(0)).collect() == []


def test_long_lists_of_ends(spark):
    rows = [(i * 3 + 10 ** (i % 9), 5, 2) for i in range(5000)] + [(9, 9, 1)]
    rows = [(r[0], 4, 5) if i < 3000 else (r[0], 4, 6) for i, r in enumerate(rows)]
    groups = {}
    for c, _, d in rows:
        groups.setdefault(d, []).append(c)
    df = spark.createDataFrame([(4, d, c, len(groups[d])) for c, _, d in rows], "rep long, depth long, conv_id long, n_ends long").repartition(7)
    for few in (1000, 100_000):
        got = {r.depth: r.ends_sha256 for r in convtrie.ends_digests(df, few).collect()}
        assert got == {d: SHA(",".join(map(str, sorted(c)))) for d, c in groups.items()}


def test_repeated_turns_are_ordered_alike(spark):
    rows = [(c, 1, "user", t) for c in (1, 2) for t in (("b", "a", "a") if c == 1 else ("a", "b", "a"))]
    got = _got(convtrie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert max(d for _, d in got) == 3 and all(v[1] == 2 for v in got.values())


# ---- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def _plain_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end(), kind))
    return [(a, kind, b) for a, _, b, kind in sorted(out)]


ODD = ["", "a@b.c", "a@b.c_d@e.f", "@b.c", "x%y@z..w a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.1.9", "4111 1111-1111 1111", "411111111111111 1", "4111  1111 1111 1111",
       "+1 (2) 3-4.5 6789 )", "++12345678901", "+1234567890123456", "é𝒳 a@b.cc 𝒳+49 30 123456", "1.2.3.4@5.6 +1.2.3.4.5.6.7.8.9", "a" * 30_000, "1" * 30_000, "9 " * 20_000, "+1" + " (" * 9000, "a@b" + ".c" * 20_000,
       "x@y.z," * 700]


def test_plain_spans_are_those_of_the_plain_patterns(spark):
    draw = random.Random(8)
    texts = ODD + ["".join(draw.choice("12.@+- a(") for _ in range(draw.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)] + [(-1, None, "b")], "doc_id long, text string, base string")
    got = {r.doc_id: [(s.start, pii.KINDS[s.kind], s.end) for s in r.base] for r in pii.with_plain_spans(df.drop("base")).collect()}
    assert got == {i: _plain_spans(t) for i, t in enumerate(texts)} | {-1: []}
    found = pii.find_personal_data(df, None).collect()
    assert all(r.base == r.spans and [(s.start, s.kind, s.end) for s in r.base] == got[r.doc_id] for r in found)


def test_best_of_overlapping_candidates(spark):
    span = "struct<start:bigint,kind:int,end:bigint"
    extra = [(0, 1, 5, .9), (3, 2, 9, .95), (8, 3, 12, .7), (20, 1, 30, .8), (29, 1, 35, .9), (40, 0, 50, .6), (52, 0, 60, .6), (52, 0, 61, .6)]
    row = spark.createDataFrame([([(33, 0, 36), (62, 1, 70)], extra)], f"base array<{span}>>, extra array<{span},score:double>>").select(pii._chosen(F.col("base"), F.col("extra")).alias("c")).first()
    assert [(s.start, s.end) for s in row.c] == [(3, 9), (40, 50), (52, 61)]


def _corpus(seed, n=400):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("etaoinshr") for _ in range(draw.randrange(2, 9)))
    card = lambda: next(c for c in iter(lambda: "4" + "".join(draw.choice("0123456789") for _ in range(15)), None) if _luhn(c))
    docs = []
    for i in range(n):
        words = [word() for _ in range(30)]
        words += [draw.choice([str(draw.randrange(10 ** draw.randrange(1, 9))), "Version 2.0.", f"{draw.randrange(30)}.{draw.randrange(12)}.{draw.randrange(2030)}", "at " + word() + ". " + word()])]
        words += [draw.choice([f"{word()}@{word()}.com", ".".join(str(draw.randrange(256)) for _ in range(4)), card(), f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}", ""])]
        draw.shuffle(words)
        docs.append((i, " ".join(words)))
    return docs


def test_disguised_cases_are_found_and_clean_texts_left_alone(spark):
    model = pii.train(spark.createDataFrame(_corpus(1), "doc_id long, text string"))
    assert set(model.thresholds) == set(pii.KINDS)
    hidden = ["jane.roe (at) mail (dot) org", "jane [at] mail.org", "192[.]168[.]7[.]20", "192 . 168 . 7 . 20", "4111.1111.1111.1111", "4111/1111/1111/1111", "00 1 212 555 0188"]
    docs = [(i, f"tera shone {h} inase trosh") for i, h in enumerate(hidden)] + [(100 + i, t) for i, (_, t) in enumerate(_corpus(2))]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    caught = sum(any(s.start <= 11 + 3 and s.end >= 11 + len(h) - 3 for s in found[i].spans) for i, h in enumerate(hidden))
    assert caught >= 5  # of seven
    assert sum(len(r.spans) > len(r.base) for i, r in found.items() if i >= 100) <= 4  # of 400 texts without disguise
    assert all(set(r.base) <= set(r.spans) for r in found.values())
    shown = pii.redact(pii.find_personal_data(spark.createDataFrame([(1, "é a@b.cc, 1.2.3.4 x")], "doc_id long, text string"), model)).first().text
    assert shown == "é [email], [ip] x"


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.train(empty) is None and pii.find_personal_data(empty, None).collect() == []
    assert pii.train(spark.createDataFrame([(1, None), (2, "no numbers")], "doc_id long, text string")) is None


def test_personal_data_is_learned_from_all_texts_by_default():
    import inspect
    assert inspect.signature(pii.train).parameters["train_docs"].default is None
