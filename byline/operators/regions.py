"""Regions of recognised pages and ranking of crawled text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.functions.text import squeeze, strip
from byline.operators.ranking import top_k

# Fixed values.
REGION_WORDS = ["university", "hospital", "institute", "department", "school", "center", "centre", "college"]
BLOCK_WORDS = ["department", "university", "hospital", "institute", "school", "college", "laboratory",
               "centre", "center"]
MARGIN = 12


def layout_regions(items: DataFrame, authors: DataFrame, pages: DataFrame) -> DataFrame:
    """Bounding boxes of the author and affiliation areas of each page.

    ``items``: (doi, item, text, box ARRAY<STRUCT<x, y>>); ``authors``: (doi, name);
    ``pages``: (doi, width, height). An item belongs to the author area when it contains
    a name token of three or more letters, to the affiliation area by list number or
    keyword. Returns (doi, region, x1, y1, x2, y2, crop_x1.. crop_y2); only papers with
    both items and authors have regions.
    """
    texts = items.withColumn("l", F.lower(strip(F.coalesce("text", F.lit(""))))).where(F.length("l") > 0)
    # The name tokens of one paper travel together, to its items only.
    tokens = (authors.select("doi", F.explode(F.regexp_extract_all(
        F.lower(F.coalesce("name", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("s"))
        .where(F.length("s") >= 3).groupBy("doi").agg(F.collect_set("s").alias("tokens")))
    named = (texts.join(tokens, "doi").where(F.exists("tokens", lambda s: F.contains("l", s)))
             .drop("tokens").withColumn("region", F.lit("author")))
    listed = texts.where(F.col("l").rlike(r"(?U)^\s*\d{1,2}\s*[.)]\s+|\b(" + "|".join(REGION_WORDS) + r")\b")) \
        .join(authors.select("doi").distinct(), "doi", "left_semi").withColumn("region", F.lit("affiliation"))
    points = named.unionByName(listed).select("doi", "region", F.explode("box").alias("p"))
    boxes = points.groupBy("doi", "region").agg(
        F.min("p.x").cast("int").alias("x1"), F.min("p.y").cast("int").alias("y1"),
        F.max("p.x").cast("int").alias("x2"), F.max("p.y").cast("int").alias("y2"))
    zero = F.lit(0)
    return boxes.join(pages, "doi").select(
        "doi", "region", "x1", "y1", "x2", "y2",
        F.greatest(zero, F.col("x1") - MARGIN).alias("crop_x1"),
        F.greatest(zero, F.col("y1") - MARGIN).alias("crop_y1"),
        F.least("width", F.col("x2") + MARGIN).alias("crop_x2"),
        F.least("height", F.col("y2") + MARGIN).alias("crop_y2"))


def block_norm(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[-_]", " ")
    return squeeze(F.regexp_replace(t, r"[^a-z0-9\s]", " "))


def numbered_units(c: Column, max_units: int | None = None) -> Column:
    """How many distinct list numbers precede a unit word, at most ``max_units`` if given."""
    found = F.regexp_extract_all(c, F.lit(
        rf"(?i)(?:^|\s)(\d{{1,2}})\s*[.)]?\s*(?:{'|'.join(BLOCK_WORDS)})\b"), F.lit(1))
    n = F.size(F.array_distinct(found))
    return n if max_units is None else F.least(n, F.lit(max_units))


def score_blocks(blocks: DataFrame, names: DataFrame, max_names: int | None = None,
                 max_chars: int | None = None, max_units: int | None = None) -> DataFrame:
    """Candidate author blocks with their score.

    ``blocks``: (doi, block, text, width, height, top, banned); ``names``: (doi, names ARRAY<STRING>). All names, all
    list numbers and blocks of 60 characters or more count, unless ``max_names``, ``max_units`` or ``max_chars`` says otherwise.
    """
    raw = strip(F.coalesce("text", F.lit("")))
    usable = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), block_norm), lambda n: F.length(n) > 0)
    usable = usable if max_names is None else F.slice(usable, 1, max_names)
    short = F.lit(True) if max_chars is None else F.length("raw") <= max_chars
    rows = (blocks.withColumn("raw", raw)
            .where(~F.coalesce("banned", F.lit(False)) & (F.length("raw") >= 60) & short
                   & (F.col("width") >= 360) & (F.col("height") >= 60) & (F.col("top") <= 1800))
            .withColumn("norm", block_norm(F.col("raw"))).where(~F.startswith("norm", F.lit("citation")))
            .withColumn("units", numbered_units(F.col("raw"), max_units)).where("units >= 2")
            .join(names, "doi", "left"))
    hits = F.size(F.filter(usable, lambda n: F.contains(F.col("norm"), n)))
    score = (F.col("units") * 80 + hits * 10
             + F.greatest(F.lit(0.0), F.lit(50.0) - F.col("top") / 30)
             - F.log(F.greatest(F.lit(1.0), F.col("width") * F.col("height") * 1.0)) / 2
             - F.length("raw") / 250)
    return rows.withColumn("hits", hits).withColumn("score", score).select(
        "doi", "block", "units", "hits", "score")


def rank_blocks(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """The best block per paper; the earlier block wins ties."""
    return (score_blocks(blocks, names).groupBy("doi")
            .agg(F.max_by(F.struct("block", "units", "hits", "score"),
                          F.struct("score", -F.col("block"))).alias("b"))
            .select("doi", "b.block", "b.units", "b.hits", "b.score"))


def ranked_blocks(blocks: DataFrame, names: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` best blocks per paper with their ``place``; the earlier block wins ties."""
    best = top_k(score_blocks(blocks, names), ["doi"], [F.col("score").desc(), F.col("block")], k)
    return best.select("doi", "place", "block", "units", "hits", "score")
