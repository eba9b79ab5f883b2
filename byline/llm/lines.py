"""Line dedup by site-relative frequency: lines that most pages of a host carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.llm.staging import staged, text_or_empty
from byline.llm.urls import host_and_path

UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html"
          r"|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[ \t\r\n/][^>]*)?>")
TAGS, BLANKS = r"<[^>]*>", r"[ \t\r\f]+"


def page_lines(html: Column) -> Column:
    """The visible lines of a page: cut at block tags and line breaks, tags removed, blanks folded, empty lines left out."""
    plain = F.regexp_replace(F.regexp_replace(text_or_empty(html), UNSEEN, ""), BREAKS, "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, TAGS, ""), BLANKS, " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, max_ratio: float = 0.3, min_pages: int = 5, url_col: str = "url",
                     html_col: str = "html") -> DataFrame:
    """``pages`` with ``host``, ``n_lines``, ``n_dropped`` and, in place of the page's source, ``kept_text`` (its kept
    lines joined by line breaks).

    A line is dropped from all pages of a host when the share of the host's pages that hold it exceeds ``max_ratio``.
    Hosts with fewer than ``min_pages`` pages keep everything: one page says nothing about a site. A line counts once a
    page. Pages without host form one site of their own that is never cut. Null or empty pages have no lines.
    The dropped lines of a host are at most its mean lines per page divided by ``max_ratio``, so they travel as one
    array per host and are applied inside each row; lines themselves never travel. Clashing columns are replaced.
    """
    made = ["host", "n_lines", "n_dropped", "kept_text"]
    rows = staged(pages.drop(*made).withColumns({"host": host_and_path(F.col(url_col))[0], "_lines": page_lines(F.col(html_col))}).drop(html_col))
    sites = rows.where("host <> ''")
    # stored tables on the small side leave the joins free to split a host that holds a third of the pages
    totals = staged(sites.groupBy("host").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages))
    held = (sites.select("host", F.explode(F.array_distinct(F.transform("_lines", lambda x: F.xxhash64(x)))).alias("_line"))
            .groupBy("host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_pages * max_ratio))
    over = staged(held.join(totals, "host").where(F.col("_n") > F.col("_pages") * F.lit(max_ratio)).select("host", "_line"))
    common = staged(over.groupBy("host").agg(F.collect_list("_line").alias("_common")))
    joined = rows.join(common, "host", "left")
    kept = F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains(F.col("_common"), F.xxhash64(x))))
    return (joined.withColumn("_kept", kept)
            .withColumns({"n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_kept")).cast("long"),
                          "kept_text": F.array_join("_kept", "\n")})
            .select(*[c for c in pages.columns if c not in (html_col, *made)], *made))
