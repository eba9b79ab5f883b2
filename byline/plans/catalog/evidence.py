"""Source fusion and evidence over two author lists of the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from byline.operators import affiliations, fusion
from byline.plans.catalog import views as V
from byline.plans.catalog.registry import query
from byline.schemas import EVIDENCE_COLUMNS

# Two author lists per order. 'base' lacks a fifth of the papers, 'other' a quarter of the authors.
BASE = f"""{V.NUMBERED_LINEITEM}, base AS (
  SELECT '10.1/' || l_orderkey AS doi, pos, 'Part ' || (l_partkey % 50) AS name,
    CASE WHEN l_partkey % 3 = 0 THEN 'Unknown' ELSE 'Brand ' || (l_partkey % 7) END AS affiliation,
    CAST(NULL AS VARCHAR[]) AS affiliations, pos AS author_order, l_returnflag = 'R' AS is_corresponding,
    false AS is_co_first, CAST(NULL AS VARCHAR) AS markers, CAST(NULL AS BOOLEAN) AS has_mail_icon, CAST(NULL AS VARCHAR) AS source,
    CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN 'openalex' END AS corresponding_source
  FROM nl WHERE l_orderkey % 5 <> 0)"""
OTHER = """other AS (
  SELECT '10.1/' || l_orderkey AS doi, pos,
    CASE WHEN l_suppkey % 3 <> 0 THEN 'PART-' || (l_partkey % 50) ELSE 'X ' || (l_suppkey % 20) END AS name,
    CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' unknown' ELSE 'Supp ' || l_suppkey END AS affiliation,
    CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE ['A' || l_suppkey, ' B '] END AS affiliations,
    pos + l_suppkey % 2 AS author_order, l_linestatus = 'F' AS is_corresponding, l_linenumber = 1 AS is_co_first,
    CASE l_suppkey % 3 WHEN 0 THEN '*' WHEN 1 THEN '#' END AS markers,
    CASE l_suppkey % 6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS has_mail_icon,
    CASE l_suppkey % 4 WHEN 2 THEN 'hover' WHEN 3 THEN 'other' END AS source,
    CASE WHEN l_suppkey % 7 = 0 THEN 'x' END AS corresponding_source
  FROM nl WHERE (l_partkey + l_suppkey) % 4 <> 0)"""


def aligned(first: str, second: str) -> str:
    """SQL: every base author with ``o``, its other author by the two criteria."""
    key = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"""by_name AS (SELECT doi, {key.format('name')} AS k, arg_max(other, pos) AS r FROM other GROUP BY ALL),
by_order AS (SELECT doi, author_order AS k, arg_max(other, pos) AS r FROM other GROUP BY ALL),
a AS (SELECT base.*, coalesce({first}.r, {second}.r) AS o FROM base
  LEFT JOIN by_name ON by_name.doi = base.doi AND by_name.k = {key.format('base.name')}
  LEFT JOIN by_order ON by_order.doi = base.doi AND by_order.k = base.author_order)"""


UNKNOWN = "coalesce(lower(trim({0})), '') IN ('', 'unknown')"
SHOWN = """doi, pos, name, affiliation, array_to_string(affiliations, '|') AS affiliations, author_order, is_corresponding,
  is_co_first, markers, has_mail_icon, source, corresponding_source"""
LONE = "(SELECT * FROM other WHERE doi NOT IN (SELECT doi FROM base))"


def _base(t):
    odd = F.col("l_returnflag") == "R"
    null = lambda kind: F.lit(None).cast(kind)
    return V.numbered_lineitem(t).where("l_orderkey % 5 <> 0").select(
        V.doi("l_orderkey").alias("doi"), "pos", F.concat(F.lit("Part "), F.col("l_partkey") % 50).alias("name"),
        F.when(F.col("l_partkey") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("Brand "), F.col("l_partkey") % 7)).alias("affiliation"),
        null("array<string>").alias("affiliations"), F.col("pos").alias("author_order"), odd.alias("is_corresponding"),
        F.lit(False).alias("is_co_first"), null("array<int>").alias("affiliation_numbers"), null("string").alias("markers"),
        null("boolean").alias("has_mail_icon"), null("string").alias("source"),
        F.when(odd & (F.col("l_suppkey") % 2 == 0), "openalex").alias("corresponding_source"))


def _other(t):
    s = F.col("l_suppkey")
    return V.numbered_lineitem(t).where("(l_partkey + l_suppkey) % 4 <> 0").select(
        V.doi("l_orderkey").alias("doi"), "pos",
        F.when(s % 3 != 0, F.concat(F.lit("PART-"), F.col("l_partkey") % 50)).otherwise(F.concat(F.lit("X "), s % 20)).alias("name"),
        F.when(s % 5 == 0, None).when(s % 5 == 1, " unknown").otherwise(F.concat(F.lit("Supp "), s)).alias("affiliation"),
        F.when(s % 4 == 0, None).when(s % 4 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("A"), s), F.lit(" B "))).alias("affiliations"),
        (F.col("pos") + s % 2).cast("int").alias("author_order"), (F.col("l_linestatus") == "F").alias("is_corresponding"),
        (F.col("l_linenumber") == 1).alias("is_co_first"),
        F.filter(F.array(F.col("l_linenumber"), (s % 3).cast("int")), lambda n: s % 5 > 1).alias("affiliation_numbers"),
        F.when(s % 3 == 0, "*").when(s % 3 == 1, "#").alias("markers"),
        F.when(s % 6 == 0, True).when(s % 6 == 1, None).otherwise(False).alias("has_mail_icon"),
        F.when(s % 4 == 2, "hover").when(s % 4 == 3, "other").alias("source"),
        F.when(s % 7 == 0, "x").alias("corresponding_source")).select(EVIDENCE_COLUMNS)


def _shown(df):
    return df.withColumn("affiliations", F.array_join("affiliations", "|")).drop("affiliation_numbers")


@query(f"""WITH {BASE}, {OTHER}, {aligned('by_order', 'by_name')}, e AS (
  SELECT doi, pos, name, CASE WHEN {UNKNOWN.format('affiliation')} AND NOT {UNKNOWN.format('o.affiliation')}
      THEN trim(o.affiliation) ELSE affiliation END AS affiliation,
    CASE WHEN len(o.affiliations) > 0 THEN o.affiliations ELSE affiliations END AS affiliations, author_order,
    is_corresponding OR coalesce(o.is_corresponding, false) AS is_corresponding, is_co_first, markers, has_mail_icon, source,
    CASE WHEN NOT is_corresponding AND o.is_corresponding THEN 'openalex' ELSE corresponding_source END AS corresponding_source
  FROM a UNION ALL SELECT * FROM {LONE}) SELECT {SHOWN} FROM e""")
def enrich_registry(t):
    return _shown(fusion.enrich_registry(_base(t), _other(t)))


@query(f"""WITH {BASE}, {OTHER}, {aligned('by_name', 'by_order')},
x AS (SELECT *, coalesce(len(o.affiliations) > 0 AND o.source = 'hover', false) AS override, coalesce(has_mail_icon, o.has_mail_icon) AS mail,
    coalesce(markers, o.markers) AS mark, CASE WHEN o.is_corresponding AND coalesce(corresponding_source, '') IN ('', 'openalex')
      THEN coalesce(nullif(o.corresponding_source, ''), 'vision') ELSE corresponding_source END AS tag FROM a),
e AS (SELECT doi, pos, name, CASE WHEN override THEN array_to_string(list_filter([trim(z) FOR z IN o.affiliations], lambda z: z <> ''), '; ')
    WHEN {UNKNOWN.format('affiliation')} AND NOT {UNKNOWN.format('o.affiliation')} THEN trim(o.affiliation) ELSE affiliation END AS affiliation,
  CASE WHEN override THEN o.affiliations WHEN coalesce(len(affiliations), 0) = 0 AND o.affiliations IS NOT NULL THEN o.affiliations
    ELSE affiliations END AS affiliations, author_order,
  CASE WHEN o IS NOT NULL AND tag = 'openalex' AND NOT coalesce(mail, false) AND NOT coalesce(contains(mark, '*'), false)
      AND NOT coalesce(o.is_corresponding, false) THEN false
    ELSE is_corresponding OR coalesce(o.is_corresponding, false) END AS is_corresponding,
  is_co_first OR coalesce(o.is_co_first, false) AS is_co_first, mark AS markers, mail AS has_mail_icon,
  coalesce(source, o.source) AS source, tag AS corresponding_source FROM x UNION ALL SELECT * FROM {LONE})
SELECT {SHOWN} FROM e""")
def fuse_registry_vision(t):
    return _shown(fusion.fuse_registry_vision(_base(t), _other(t)))


@query(f"""WITH {BASE}, {OTHER}, {aligned('by_name', 'by_order')},
x AS (SELECT *, o IS NOT NULL AND (coalesce(o.has_mail_icon, false) OR coalesce(contains(o.markers, '*'), false)
    OR coalesce(o.is_corresponding, false)) AS strong FROM a),
merged AS (SELECT doi, pos, name, CASE WHEN {UNKNOWN.format('affiliation')} AND NOT {UNKNOWN.format('o.affiliation')}
    THEN trim(o.affiliation) ELSE affiliation END AS affiliation, affiliations, author_order,
  strong OR is_corresponding AS is_corresponding, is_co_first OR coalesce(o.is_co_first, false) AS is_co_first, o.markers AS markers,
  o.has_mail_icon AS has_mail_icon, o.source AS source, CASE WHEN strong AND coalesce(corresponding_source, '') = ''
    THEN CASE WHEN o.has_mail_icon THEN 'hover_icon' WHEN contains(o.markers, '*') THEN 'hover_star' ELSE 'hover' END
    ELSE corresponding_source END AS corresponding_source FROM x),
keys AS (SELECT DISTINCT doi, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM base),
firsts AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM other
  QUALIFY row_number() OVER (PARTITION BY doi, k ORDER BY pos) = 1),
added AS (SELECT f.* EXCLUDE (k) REPLACE (f.pos + l.last AS pos) FROM firsts f JOIN (SELECT doi, max(pos) AS last FROM base GROUP BY doi) l USING (doi)
  WHERE NOT EXISTS (SELECT 1 FROM keys WHERE keys.doi = f.doi AND keys.k = f.k)),
e AS (SELECT * FROM merged UNION ALL BY NAME SELECT * FROM added UNION ALL BY NAME SELECT * FROM {LONE}) SELECT {SHOWN} FROM e""")
def merge_hover(t):
    return _shown(fusion.merge_hover(_base(t), _other(t)))


@query(f"""WITH {BASE} SELECT doi, count(*) FILTER (affiliation <> 'Unknown') / count(*) < 0.2 AS mostly_unknown FROM base GROUP BY doi""")
def mostly_unknown(t):
    return fusion.mostly_unknown(_base(t))


QUALITY = """quality AS (SELECT doi, count(*) AS n, sum(10 + CASE WHEN coalesce(trim(affiliation), '') <> '' OR len(affiliations) > 0 THEN 2 ELSE 0 END
  + CASE WHEN CAST(regexp_extract(coalesce(affiliation, ''), '[0-9]+$') AS VARCHAR) <> '' AND numbered THEN 1 ELSE 0 END) AS quality
  FROM q GROUP BY doi)"""


@query(f"""WITH {V.NUMBERED_LINEITEM}, {OTHER.replace('WHERE (', 'WHERE (')}, q AS (
  SELECT other.*, true AS numbered FROM other), {QUALITY} SELECT doi, n, quality FROM quality""")
def source_quality(t):
    return fusion.source_quality(_other(t))


@query(f"""WITH {V.NUMBERED_LINEITEM}, p AS (SELECT l_orderkey, pos, l_returnflag FROM nl),
b AS (SELECT l_orderkey, count(*) AS n FROM p WHERE l_returnflag = 'A' GROUP BY ALL),
c AS (SELECT l_orderkey, count(*) AS n FROM p WHERE l_returnflag <> 'A' GROUP BY ALL),
r AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT c.l_orderkey FROM c JOIN r USING (l_orderkey) LEFT JOIN b USING (l_orderkey)
  WHERE (b.n IS NULL OR b.n < greatest(1, floor(r.n * 0.6))) AND c.n > coalesce(b.n, 0))
SELECT '10.1/' || l_orderkey AS doi, pos, l_returnflag <> 'A' AS from_alternative FROM p
WHERE (l_returnflag <> 'A') = (l_orderkey IN (SELECT l_orderkey FROM s))""")
def pick_source(t):
    rows = V.numbered_lineitem(t).select(
        V.doi("l_orderkey").alias("doi"), "pos", "l_returnflag", F.lit("u").alias("affiliation"),
        F.lit(None).cast("array<string>").alias("affiliations"), F.lit(None).cast("array<int>").alias("affiliation_numbers"))
    base, other = rows.where("l_returnflag = 'A'"), rows.where("l_returnflag <> 'A'")
    return fusion.pick_source(base, other, rows).select("doi", "pos", "from_alternative")


@query(f"""WITH {BASE}, {OTHER}, nums AS (
  SELECT '10.1/' || l_orderkey AS doi, pos, CASE WHEN l_suppkey % 5 > 1 THEN len(list_distinct([l_linenumber, CAST(l_suppkey % 3 AS INT)])) ELSE 0 END AS k FROM nl),
h AS (SELECT doi, count(*) AS n, bool_and((coalesce(trim(affiliation), '') <> '' OR len(list_filter(affiliations, lambda z: trim(z) <> '')) > 0)
    IS TRUE AND NOT (k >= 3)) AS ok FROM other JOIN nums USING (doi, pos) GROUP BY doi),
r AS (SELECT doi, count(*) AS m FROM base GROUP BY doi)
SELECT doi, ok AND (m IS NULL OR n = m) AS complete FROM h LEFT JOIN r USING (doi)""")
def hover_complete(t):
    return fusion.hover_complete(_other(t), _base(t))


@query(r"""WITH l AS (SELECT doc_id, [trim(z) FOR z IN string_split(text, chr(10)) IF trim(z) <> ''] AS v FROM documents),
d AS (SELECT doc_id, v, len(list_distinct([lower(z) FOR z IN v])) AS n FROM l)
SELECT doc_id, CASE WHEN n > 1 AND n / len(v) >= 0.45 THEN len(v) END AS kept FROM d""")
def meta_institutions(t):
    return t.documents.select("doc_id", F.size(fusion.usable_meta_institutions(F.split("text", "\n"))).alias("kept")).withColumn(
        "kept", F.when(F.col("kept") >= 0, F.col("kept")))


@query("""SELECT event_id, trim(CASE WHEN user_id % 4 = 0 THEN ' ' || event_type || ' ' ELSE event_type END) AS name,
  CASE WHEN user_id % 3 = 0 THEN user_id ELSE 999 END AS author_order, user_id % 2 = 0 AS is_corresponding,
  CASE WHEN user_id > 0 THEN '7,' || user_id ELSE '7' END AS numbers FROM events WHERE event_type <> 'view' AND user_id % 10 <> 0""")
def normalise_authors(t):
    u = F.col("user_id")
    raw = t.events.select(
        "event_id", F.when(u % 10 == 0, None).when(F.col("event_type") == "view", " UNKNOWN").when(
            u % 4 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise(F.col("event_type")).alias("name"),
        F.lit(" x ").alias("affiliation"), F.when(u % 3 == 0, u.cast("string")).when(u % 3 == 1, "n/a").alias("author_order"),
        F.when(u % 2 == 0, True).alias("is_corresponding"), F.lit(None).cast("boolean").alias("is_co_first"),
        F.array(F.lit(" "), F.lit("y ")).alias("affiliations"),
        F.array(F.lit("7"), F.lit("-1"), F.lit("x"), u.cast("string")).alias("affiliation_numbers"))
    return fusion.normalise_authors(raw).select(
        "event_id", "name", "author_order", "is_corresponding",
        F.array_join(F.col("affiliation_numbers").cast("array<string>"), ",").alias("numbers"))


@query(f"""WITH {BASE}, {OTHER}, keyed AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM other),
r AS (SELECT DISTINCT doi, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, true AS hit FROM base),
s AS (SELECT doi, pos, coalesce(hit, false) AS reg, coalesce(len(list_filter(affiliations, lambda z: trim(z) <> '')) > 0, false)
    OR coalesce(source = 'hover', false) AS st, coalesce(has_mail_icon, false) OR coalesce(contains(markers, '*'), false) AS mk
  FROM keyed LEFT JOIN r USING (doi, k))
SELECT doi, pos, round(CAST(CASE WHEN reg THEN 0.4 ELSE 0 END + 0.4 + CASE WHEN st THEN 0.1 ELSE 0 END + CASE WHEN mk THEN 0.1 ELSE 0 END AS DOUBLE), 6) AS evidence_score,
  concat_ws(',', CASE WHEN reg THEN 'crossref' END, 'vision', CASE WHEN st THEN 'structured_aff' END, CASE WHEN mk THEN 'correspondence_marker' END) AS sources FROM s""")
def evidence_scores(t):
    return fusion.evidence_scores(_other(t), _base(t), _other(t)).select(
        "doi", "pos", F.round("evidence_score", 6).alias("evidence_score"), F.array_join("evidence_sources", ",").alias("sources"))


@query(f"""WITH {V.NUMBERED_LINEITEM}, a AS (SELECT l_orderkey, pos, l_returnflag, [CAST(l_linenumber AS BIGINT), l_suppkey % 5] AS ns FROM nl),
u AS (SELECT l_orderkey, pos, i, ns[i] AS num FROM a, unnest([1, 2]) AS q(i) WHERE ns[i] > 0),
m AS (SELECT l_orderkey, pos, string_agg('Unit ' || num || o_orderstatus, '; ' ORDER BY i) AS affs, count(*) FILTER (o_orderkey IS NULL) AS missing,
  count(o_orderkey) AS found FROM u LEFT JOIN orders ON o_orderkey = l_orderkey AND num <= 3 AND l_orderkey % 4 <> 0 GROUP BY ALL)
SELECT '10.1/' || l_orderkey AS doi, pos, CASE WHEN found > 0 THEN affs WHEN l_returnflag = 'R' THEN 'Old' ELSE 'Unknown' END AS affiliation,
  CASE WHEN found = 0 THEN 'missing' WHEN missing > 0 THEN 'partial' ELSE 'mapped' END AS map_status FROM a JOIN m USING (l_orderkey, pos)""")
def map_numbers(t):
    authors = V.numbered_lineitem(t).select(
        V.doi("l_orderkey").alias("doi"), "pos", F.when(F.col("l_returnflag") == "R", "Old").alias("affiliation"),
        F.lit(None).cast("array<string>").alias("affiliations"),
        F.array("l_linenumber", (F.col("l_suppkey") % 5).cast("int")).alias("affiliation_numbers"))
    maps = t.orders.where("o_orderkey % 4 <> 0").select(
        V.doi("o_orderkey").alias("doi"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("num"), "o_orderstatus").select(
        "doi", "num", F.concat(F.lit("Unit "), "num", "o_orderstatus").alias("affiliation"))
    return affiliations.map_numbers(authors, maps).select("doi", "pos", "affiliation", "map_status")


@query()
def affiliation_maps(t):
    """Given maps, document text and page institutions of the same papers."""
    key = F.col("doc_id").cast("string").alias("doi")
    given = t.documents.where("doc_id % 3 = 0").select(key, F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("i", "affiliation")) \
        .select("doi", (F.col("i") + 1).alias("num"), "affiliation")
    texts = t.documents.where("doc_id % 3 = 1").select(key, F.concat(F.lit("1. School, "), "text").alias("text"))
    meta = t.documents.where("doc_id % 2 = 0").select(key, F.slice(F.split("text", r"[\n.]"), 1, 3).alias("institutions"))
    return affiliations.resolve_affiliation_maps(given, texts, meta)
