"""The operators as queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byline.llm import bpe, convtrie, ctw, exact, lines, mixing, multiindex, ordermin, pii, substrings, toxicity, urls, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), prefer="largest")


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


@query(rf"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(regexp_extract(coalesce(url, ''), '(?s)://(.*)$', 1), '^[^/?#]*'),
                            '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_replace(regexp_replace(coalesce(html, ''), '{lines.UNSEEN}', '', 'g'), '{lines.BREAKS}', chr(10), 'g') AS t
  FROM pages),
split AS (
  SELECT page_id, host, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '{lines.TAGS}', '', 'g'),
         '{lines.BLANKS}', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM cut),
totals AS (SELECT host, count(*) AS pages FROM split WHERE host <> '' GROUP BY host HAVING count(*) >= 5),
held AS (SELECT host, l, count(*) AS n FROM (SELECT host, unnest(list_distinct(ls)) AS l FROM split) GROUP BY host, l),
common AS (SELECT host, list(l) AS cs FROM held JOIN totals USING (host) WHERE n > pages * 0.3::DOUBLE GROUP BY host),
kept AS (SELECT page_id, split.host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(cs, []), x)) AS ks
         FROM split LEFT JOIN common ON split.host = common.host)
SELECT page_id, host, len(ls)::BIGINT AS n_lines, (len(ls) - len(ks))::BIGINT AS n_dropped,
       coalesce(array_to_string(ks, chr(10)), '') AS kept_text FROM kept
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "host", "n_lines", "n_dropped", "kept_text")


PATH_RULES = [urls.PathRule("allow", "org", "/"), urls.PathRule("block", "example.org", "/es/"),
              urls.PathRule("block", "example.org", "/en/1"), urls.PathRule("allow", "com", "/fr/"),
              urls.PathRule("block", "com", "/de/")]
PATTERN_RULES = [urls.PatternRule("block", "^spam-farm^"), urls.PatternRule("block", "^cheap-pills^"),
                 urls.PatternRule("block", "^casino^"), urls.PatternRule("block", "^free-money^"),
                 urls.PatternRule("block", "^adult^*^video^"), urls.PatternRule("block", "^click^*^redirect^"),
                 urls.PatternRule("block", "^utm_source^feed^"), urls.PatternRule("allow", "^page^2^ref^x^")]


@query(f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{urls.UPPER}', '{urls.LOWER}') AS u,
         regexp_extract(coalesce(url, ''), '(?s)://(.*)$', 1) AS rest FROM pages),
parts AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_filter([{", ".join(f"CASE WHEN regexp_matches(u, '{r.regex}') THEN '{r.pattern}' END" for r in sorted(PATTERN_RULES, key=lambda r: r.pattern))}],
                lambda x: x IS NOT NULL) AS patterns
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN len(patterns) > 0 AND NOT list_contains(patterns, '^page^2^ref^x^') THEN 'block' ELSE 'allow' END AS verdict,
  array_to_string(patterns, ' ') AS patterns
FROM ruled
""")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), PATH_RULES, PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("patterns", " ").alias("patterns"))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS t
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w)),
firsts AS (SELECT t, min(doc_id) AS m FROM windows GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM windows JOIN firsts USING (t) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score_texts(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query()
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out("doc_id", 5)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"), target_recall=1)


def _slip(doc_id, run):
    """One letter less in one of about 199 runs, told by the checksum of document and run."""
    h = F.crc32(F.concat_ws(":", doc_id, run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % 199 == 0, cut).otherwise(run)


#: CRC-32 in SQL: the table by its rule, then one step per byte of a text of code points below U+0800.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def crc_sql(text: str) -> str:
    code = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"
    return f"xor(list_reduce(list_concat([4294967295], {code}::BIGINT[]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@query(rf"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
counted AS (SELECT doc_id, r, count(*) AS k FROM runs WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (SELECT r, k, {crc_sql("doc_id || ':' || r")} AS h FROM counted, crc),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n AS m FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.i = y.i WHERE x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.a || c.b = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.a || c.b = w.word),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (m, -rank)) AS top, max(m) AS top_n
         FROM near JOIN (SELECT word AS other, row_number() OVER (ORDER BY word) AS rank FROM words) USING (other) GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, word AS here, 0 AS d FROM forms
         UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, d) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(variants.word_counts(table(spark, sf_dir, "documents"), change=_slip), ratio=5)


@query(rf"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS r, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base FROM own GROUP BY conv_id),
convs AS MATERIALIZED (SELECT conv_id, n, base, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM counts, crc),
rebuilt AS (
  SELECT c.conv_id, o.r AS p, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.r < c.h
  UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.r - c.h, role, text
  FROM convs c JOIN own o ON o.conv_id = c.conv_id LEFT JOIN convs b ON b.conv_id = c.base WHERE o.r >= c.h),
seqs AS (SELECT convs.conv_id, coalesce(ks, []) AS ks, ws FROM convs LEFT JOIN (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY p) AS ks, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY p) AS ws
  FROM rebuilt GROUP BY conv_id) s ON s.conv_id = convs.conv_id),
paths AS MATERIALIZED (SELECT conv_id, d, array_to_string(ks[1:d], ' ') AS k, d = len(ks) AS last, coalesce(ws[d], 0) AS w
                       FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d AS depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM paths GROUP BY d, k),
kin AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.k, greatest(length(c.k) - 33, 0)) = n.k) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = left(n.k, greatest(length(n.k) - 33, 0))),
rolled AS (SELECT a.d, a.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n.w)::BIGINT AS saved_tokens
           FROM kin n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.depth GROUP BY a.d, a.k)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM kin JOIN rolled ON rolled.d = kin.depth AND rolled.k = kin.k
""")
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = convtrie.with_shared_heads(convtrie.ordered_turns(table(spark, sf_dir, "conversations")), family=20, heads=4)
    return convtrie.prefix_trie(turns, convs)


@query()
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
