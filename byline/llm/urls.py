"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PathRule(NamedTuple):
    """Fits ``host`` and its subdomains if the path starts with ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    """``pattern``: ``*`` stands for any characters, ``^`` for a separator or an end, the rest for itself."""
    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        parts = {"*": ".*", "^": "(?:^|[^a-z0-9]|$)"}
        return "(?s)" + "".join(parts.get(c) or re.escape(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that every fitting URL has as whole tokens."""
        return [m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", self.pattern)]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://(.*)$", 1)
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def rarest_tokens(pages: DataFrame, rules: list[PatternRule], url_col: str) -> dict[str, list[PatternRule]]:
    """The index: each rule under that of its tokens which the fewest URLs hold (ties: the first in the alphabet).

    Only tokens of rules are counted, so what reaches the driver is one number per such token.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if bare := [r.pattern for r in rules if not r.tokens]:
        raise ValueError(f"pattern rules without a whole literal token: {bare}")
    if not wanted:
        return {}
    held = F.array_intersect(_tokens(F.col(url_col)), F.array(*map(F.lit, wanted)))
    counts = {r["t"]: r["n"] for r in pages.select(F.explode(held).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[PatternRule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def filter_urls(pages: DataFrame, path_rules: list[PathRule], pattern_rules: list[PatternRule],
                url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``patterns`` and ``verdict``; columns of these names are replaced.

    The longest fitting path rule decides. Without one, the URL's tokens fetch their pattern rules from the index,
    only those run as regular expressions over the lower-cased URL (``patterns`` lists those that fit, in order),
    and the verdict is ``block`` if a block rule fits and no allow rule does, else ``allow``. Null and empty URLs have empty
    host and path, no rule, and are allowed. Everything happens inside the row: no shuffle but the token counts.
    """
    index = rarest_tokens(pages, pattern_rules, url_col)
    host, path = host_and_path(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "patterns", "verdict").withColumns({"host": host, "path": path})
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(path_rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked last, so it wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, said = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(said)
    text = lowered(F.coalesce(F.col(url_col), F.lit("")))
    if index:
        entry = lambda r: F.struct(F.lit(r.pattern).alias("p"), F.lit(r.regex).alias("x"), F.lit(r.verdict).alias("v"))
        held = F.create_map(*[c for t, rules in index.items() for c in (F.lit(t), F.array(*map(entry, rules)))])
        fetched = F.flatten(F.transform(F.array_intersect(_tokens(F.col(url_col)), F.array(*map(F.lit, index))),
                                        lambda t: F.element_at(held, t)))
        fitting = F.filter(fetched, lambda r: F.regexp_like(text, r["x"]))
        rows = rows.withColumn("_fit", fitting)
        patterns = F.sort_array(F.transform("_fit", lambda r: r["p"]))
        method = F.when(F.exists("_fit", lambda r: r["v"] == "block") & ~F.exists("_fit", lambda r: r["v"] == "allow"), "block").otherwise("allow")
    else:
        rows, patterns, method = rows.withColumn("_fit", F.lit(None)), F.array().cast("array<string>"), F.lit("allow")
    return rows.withColumns({"rule": rule, "patterns": patterns, "verdict": F.coalesce(said, method)}).drop("_fit")
