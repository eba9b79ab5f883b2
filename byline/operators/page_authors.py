"""Authors of a landing page: each raised mark belongs to the nearest name before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from byline.functions.markers import sane_numbers, superscript_marks, superscript_numbers
from byline.functions.text import ignored_name, placed_matches, strip, ui_name

OPENS, CLOSES = "\u0001", "\u0002"
UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"


def marked_text(html: Column) -> Column:
    """The visible text of a page on one line, what is raised (``<sup>``) between two control characters."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")
    raised = F.regexp_replace(F.translate(seen, OPENS + CLOSES, ""), r"(?is)<sup(?:\s[^>]*)?>(.*?)</sup>", f"{OPENS}$1{CLOSES}")
    return F.regexp_replace(F.regexp_replace(raised, "<[^>]*>", " "), r"[ \t\r\n]+", " ")


def nearest_before(marks: DataFrame, names: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of ``marks`` with the columns of the last row of ``names`` at or before them, of equal ``keys``; others are dropped.

    An as-of join: both sides are one stream in order of ``at`` (names first at the same place), and the last name seen is
    carried along, so no mark meets more than one name.
    """
    carried = [c for c in names.columns if c not in (*keys, at)]
    own = [c for c in marks.columns if c not in (*keys, at)]
    stream = names.select(*keys, at, F.lit(0).alias("_side"), F.struct(*carried).alias("_name"), F.lit(None).cast(marks.select(F.struct(*own)).schema[0].dataType).alias("_mark"))
    stream = stream.unionByName(marks.select(*keys, at, F.lit(1).alias("_side"), F.lit(None).cast(names.select(F.struct(*carried)).schema[0].dataType).alias("_name"), F.struct(*own).alias("_mark")))
    so_far = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = stream.withColumn("_last", F.last("_name", ignorenulls=True).over(so_far)).where("_side = 1 AND _last IS NOT NULL")
    return met.select(*keys, at, "_mark.*", "_last.*")


def page_authors(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(page_id, pos, name, affiliation_numbers, markers, is_corresponding, is_co_first) of the names that stand in a page.

    ``pages``: page_id, html, max_num (number of its institutions, 0: unknown). ``names``: page_id, pos, name, such as
    those of its meta tags; blank names and words of the user interface are left out. A name stands where its first
    occurrence is. Numbers and symbols raised behind it, up to the next name, are its own; numbers that the
    page's institutions rule out are dropped. The first two authors share the first place if the page says so.
    """
    rows = pages.select("page_id", "max_num", marked_text(F.col("html")).alias("text"))
    wanted = names.select("page_id", "pos", strip(F.col("name")).alias("name")).where((F.col("name") != "") & ~ignored_name(F.col("name")) & ~ui_name(F.col("name")))
    found = (wanted.join(rows.select("page_id", F.lower("text").alias("low")), "page_id")
             .withColumn("s", F.position(F.lower("name"), F.col("low"))).where("s > 0")
             .select("page_id", (F.col("s") - 1 + F.char_length("name")).alias("place"), "pos", "name"))
    marks = (rows.select("page_id", F.explode(placed_matches(F.col("text"), f"{OPENS}[^{CLOSES}]*{CLOSES}")).alias("m"))
             .select("page_id", F.col("m.s").alias("place"), F.col("m.w").alias("mark")))
    # names that end at one place are one name, the longest: it comes last
    ends = found.groupBy("page_id", "place").agg(F.max_by(F.struct("pos", "name"), F.struct(F.char_length("name"), (-F.col("pos")).alias("turn"))).alias("n")).select("page_id", "place", "n.pos", "n.name")
    owned = (nearest_before(marks, ends, ["page_id"], "place").groupBy("page_id", "pos")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "mark"))), lambda m: m["mark"]), " ").alias("raised")))
    facts = rows.select("page_id", "max_num", (F.lower("text").rlike("contributed equally|equal contribution")).alias("equal_note"))
    marked = found.select("page_id", "pos", "name").join(owned, ["page_id", "pos"], "left").join(facts, "page_id")
    numbers = sane_numbers(superscript_numbers(F.col("raised")), F.col("max_num"))
    signs = superscript_marks(F.col("raised"))
    return marked.select("page_id", "pos", "name", numbers.alias("affiliation_numbers"), signs.alias("markers"),
                         signs.contains("*").alias("is_corresponding"), (F.col("equal_note") & (signs.rlike("[#†‡]") | (F.col("pos") <= 2))).alias("is_co_first"))
