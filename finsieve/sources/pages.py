"""Enforcement index pages: links, table rows and page text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions.text import SITE, html_text, unescape

# target in double quotes, single quotes or none: groups 1-3; group 4 is the text
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
_CELL = r"(?is)<td[^>]*>(.*?)</td>"
_RELEASE = r"(?i)AAER.?\d{3,4}"


def _absolute(href: Column, site: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href)


def _target(group: Callable[[int], Column]) -> Column:
    """The target of an anchor from the groups of its three quotings; entities in it are resolved."""
    return unescape(F.concat(*[group(i) for i in (1, 2, 3)]))


def page_anchors(pages: DataFrame, site: str = SITE) -> DataFrame:
    """(page_id, pos, url, raw_text): every anchor in document order."""
    found = F.regexp_extract_all("html", F.lit(_ANCHOR), 0)
    anchors = pages.select("page_id", F.posexplode(found).alias("pos", "a")).select(
        "page_id", "pos", _target(lambda i: F.regexp_extract("a", _ANCHOR, i)).alias("href"),
        html_text(F.regexp_extract("a", _ANCHOR, 4)).alias("raw_text"),
    )
    return anchors.select("page_id", "pos", _absolute(F.col("href"), site).alias("url"), "href", "raw_text")


def index_entries(pages: DataFrame, site: str = SITE) -> DataFrame:
    """(page_id, kind, pos, url, raw_text): release links, then table rows.

    A link counts when its target or text mentions a release; a row needs
    three cells and a release number, and takes its first link as target.
    """
    links = page_anchors(pages, site).filter(
        F.lower("href").contains("aaer") | F.col("raw_text").contains("AAER")
    ).select("page_id", F.lit("link").alias("kind"), "pos", "url", "raw_text")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_ROW), 1)).alias("pos", "row"))
    cells = rows.select(
        "page_id", "pos", _target(lambda i: F.regexp_extract("row", _ANCHOR, i)).alias("href"),
        F.regexp_extract_all("row", F.lit(_CELL), 1).alias("cells"),
    ).filter(F.size("cells") >= 3)
    texts = cells.select(
        "page_id", "pos", "href",
        F.array_join(F.transform("cells", html_text), " ").alias("raw_text"),
    ).filter(F.col("raw_text").rlike(_RELEASE))
    table = texts.select(
        "page_id", F.lit("row").alias("kind"), "pos", _absolute(F.col("href"), site).alias("url"), "raw_text"
    )
    return links.unionByName(table)


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_text(F.col("html")).alias("text"))
