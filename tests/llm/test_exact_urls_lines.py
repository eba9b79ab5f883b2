"""Exact dedup, URL filters and line dedup on small tables with every odd case."""

import hashlib

import pytest

from byline.llm import exact, lines, urls

DOCS = "doc_id long, text string, source string, kept string"


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_exact_duplicates_by_hand(spark):
    rows = [(1, "a", "s", "x"), (2, "a", "s", "x"), (3, None, "s", "x"), (4, "", None, None), (5, "A", "s", "x"),
            (None, "a", "s", "x"), (2, "a", "t", "y"), (6, "long " * 50_000, "s", "x")]
    got = exact.exact_duplicates(_docs(spark, rows).repartition(5), fan_in=2).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in by[sha("a")])] == [[(0, 2, 4), (1, 2, 4), (2, 2, 4), (2, 2, 4)]]
    assert all(sum(r.kept for r in group) == 1 for group in by.values())
    assert {(r.doc_id, r.kept) for r in by[sha("")]} == {(3, False), (4, True)}
    assert by[sha("A")][0].keep_id == 5


def test_smallest_id_and_rows_without_ids(spark):
    got = exact.exact_duplicates(_docs(spark, [(7, "a", "", ""), (4, "a", "", ""), (None, "a", "", ""), (None, "b", "", ""), (None, "b", "", "")]), prefer="smallest").collect()
    assert {r.keep_id for r in got if r.text_sha256.startswith(hashlib.sha256(b"a").hexdigest()[:9])} == {4}
    assert sum(r.kept for r in got) == 2


def test_dropped_duplicates_keep_all_columns(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"own {i}", "s", str(i)) for i in range(60)] + [(58, "same", "s", "again")]
    _docs(spark, rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = exact.drop_exact_duplicates(docs, fan_in=2)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i in range(60) if i % 3 == 0] + [59 if 59 % 3 else 58])


def test_empty_table(spark):
    assert exact.exact_duplicates(_docs(spark, [])).collect() == []
    assert exact.drop_exact_duplicates(_docs(spark, [])).collect() == []


PATHS = [urls.PathRule("allow", "org", "/"), urls.PathRule("block", "example.org", "/es/")]
PATTERNS = [urls.PatternRule("block", "^casino^"), urls.PatternRule("allow", "^casino^*^review^"), urls.PatternRule("block", "^a.b^c^")]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://Example.ORG/es/1?x=/en/", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://m.example.org/en", "m.example.org", "/en", "org/", "allow"),
    ("http://badexample.org", "badexample.org", "", None, "allow"),
    ("https://casino.com/#x", "casino.com", "/", None, "block"),
    ("https://mycasino.com/", "mycasino.com", "/", None, "allow"),
    ("https://casino.com/x/review", "casino.com", "/x/review", None, "allow"),
    ("ftp://x://casino?y", "x:", "//casino", None, "block"),
    ("HTTP://A.B/C", "a.b", "/C", None, "block"),
    ("http://axb/c", "axb", "/c", None, "allow"),
    ("no scheme casino", "", "", None, "block"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://ex.com/a\nb?c", "ex.com", "/a\nb", None, "allow"),
])
def test_url_verdicts(spark, url, host, path, rule, verdict):
    got = urls.filter_urls(spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, rule string, host string"), PATHS, PATTERNS).collect()[0]
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def test_rules_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a/b"] * 3 + ["http://c/d"])], "page_id long, url string")
    rule = urls.PatternRule("block", "^a^b^q^")
    assert list(urls.rarest_tokens(pages, [rule], "url")) == ["q"]
    with pytest.raises(ValueError):
        urls.rarest_tokens(pages, [urls.PatternRule("block", "*spam*")], "url")
    assert urls.filter_urls(pages.limit(0), PATHS, PATTERNS).collect() == []
    assert {r.verdict for r in urls.filter_urls(pages, [], []).collect()} == {"allow"}


def test_boilerplate_by_brute_force(spark):
    pages = []
    for i in range(40):
        host = ["http://A.com", "http://b.com", "nohost", None][min(i % 5, 3)]
        body = f"<p>menu</p><p>text {i}</p><li>{'promo' if i % 2 else 'news'}</li><br>again<br>again"
        pages.append((i, None if host is None else f"{host}/{i}", None if i == 7 else body, "c"))
    pages += [(100, "http://c.com/1", "<p>menu</p>", "c"), (101, "http://c.com/2", "", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, n_lines string")
    got = {r.page_id: r for r in lines.drop_boilerplate(df, max_ratio=0.6, min_pages=5).collect()}
    assert len(got) == len(pages)
    split = lambda h: [x for x in ["menu", f"text {h[0]}", "promo" if h[0] % 2 else "news", "again", "again"]] if h[2] and h[0] < 100 else (["menu"] if h[2] else [])
    host = lambda u: (u.split("://")[1].split("/")[0].lower() if u and "://" in u else "")
    for page in pages:
        site = [p for p in pages if host(p[1]) == host(page[1])]
        own, kept = split(page), []
        for line in own:
            share = sum(line in split(p) for p in site) / len(site)
            if not (host(page[1]) and len(site) >= 5 and share > 0.6):
                kept.append(line)
        r = got[page[0]]
        assert (r.host, r.n_lines, r.n_dropped, r.kept_text) == (host(page[1]), len(own), len(own) - len(kept), "\n".join(kept))
    assert lines.drop_boilerplate(df.limit(0)).collect() == []


def test_visible_lines(spark):
    html = "<STYLE>p{}</STYLE><Div>a <b>bold</b>\tword</div><!-- x --><p class='q'>c</p>d<br/>e<script>var t='</p>';</script> <pre>f\ng</pre>"
    got = lines.drop_boilerplate(spark.createDataFrame([(1, "http://x/", html)], "page_id long, url string, html string")).collect()[0]
    assert got.kept_text.split("\n") == ["a bold word", "c", "d", "e", "f", "g"]
