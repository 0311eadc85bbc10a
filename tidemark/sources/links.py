"""Links of an index page: extraction from HTML, child rule, directory flag and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markup that hides anchors, the anchor pattern, and prefixes that are not children.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
NOT_CHILD = ("/", "?", "#", "icons/")


def hrefs(html: Column) -> Column:
    """All anchor targets in page order, quotes stripped and ``&amp;`` decoded."""
    found = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(ANCHOR), F.lit(1))
    return F.transform(found, lambda h: F.replace(F.trim(F.regexp_replace(h, "^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&")))


def is_child(href: Column) -> Column:
    outside = (href == "") | (href == "../")
    for prefix in NOT_CHILD:
        outside = outside | href.startswith(prefix)
    return ~outside


def extract_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per link: position on the page, target, whether it is a child entry and a directory."""
    links = pages.select(key, F.posexplode(hrefs(F.col(html))).alias("pos", "href"))
    return links.select(
        key, "pos", "href", is_child(F.col("href")).alias("is_child"), F.col("href").endswith("/").alias("is_dir")
    )


def wants_year(path: Column, years: list[str] | None) -> Column:
    """The year filter applies to first-level folders only."""
    if years is None:
        return F.lit(True)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return (F.size(parts) != 1) | F.get(parts, F.lit(0)).isin(*years)


def wants_extension(path: Column, extensions: list[str] | None) -> Column:
    if extensions is None:
        return F.lit(True)
    lowered = F.lower(path)
    keep = F.lit(False)
    for e in extensions:
        keep = keep | lowered.endswith(e.lower())
    return keep


def child_links(pages: DataFrame, years: list[str] | None = None, extensions: list[str] | None = None, **kw) -> DataFrame:
    """Child entries to follow: folders by the year rule, files by the extension rule."""
    links = extract_links(pages, **kw).filter("is_child")
    keep = F.when(F.col("is_dir"), wants_year(F.col("href"), years)).otherwise(wants_extension(F.col("href"), extensions))
    return links.filter(keep)
