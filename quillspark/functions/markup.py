"""Inline markdown of text runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, is_blank, trim_u


def inline(text, bold, italic) -> Column:
    """A run with its emphasis; white space alone stays bare."""
    text = _c(text)
    stars = F.repeat(F.lit("*"), F.when(_c(bold), 2).otherwise(0) + F.when(_c(italic), 1).otherwise(0))
    return F.when(is_blank(text), text).otherwise(F.concat(stars, text, stars))


def link(text, url) -> Column:
    """[text](url), or nothing without text."""
    t = trim_u(text)
    return F.when(t == "", "").otherwise(F.concat(F.lit("["), t, F.lit("]("), _c(url), F.lit(")")))


def runs_markdown(runs) -> Column:
    """Array of struct(text, bold, italic, link_url), in order -> markdown; neighbours with one URL share a link.
    The fold carries the finished text, the open link's text and its URL."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("open"), F.lit(None).cast("string").alias("url"))

    def closed(a):
        return F.when(a["url"].isNull(), a["out"]).otherwise(F.concat(a["out"], link(a["open"], a["url"])))

    def step(a, r):
        piece = inline(r["text"], r["bold"], r["italic"])
        same = a["url"].isNotNull() & a["url"].eqNullSafe(r["link_url"])
        linked = F.struct(F.when(same, a["out"]).otherwise(closed(a)).alias("out"), F.when(same, F.concat(a["open"], piece)).otherwise(piece).alias("open"), r["link_url"].alias("url"))
        bare = F.struct(F.concat(closed(a), piece).alias("out"), F.lit("").alias("open"), F.lit(None).cast("string").alias("url"))
        return F.when(r["link_url"].isNull(), bare).otherwise(linked)

    return F.aggregate(_c(runs), start, step, closed)


#: What follows the first keyword of a field instruction, and the URL there, quoted or bare.
HYPERLINK_REST = r"(?is)hyperlink(.*)"
HYPERLINK_URL = r'\A\s*(?:"([^"]*)"?|([^\s\\"][^\s\\]*))'


def hyperlink_url(instruction) -> Column:
    """The URL after the first HYPERLINK keyword of a field instruction, quoted or bare; else null."""
    rest = F.regexp_extract(_c(instruction), HYPERLINK_REST, 1)
    return F.nullif(F.concat(F.regexp_extract(rest, HYPERLINK_URL, 1), F.regexp_extract(rest, HYPERLINK_URL, 2)), F.lit(""))


def heading_level(style) -> Column:
    """Heading level of a paragraph style's name; null for others."""
    c = _c(style)
    low = F.lower(c)
    number = lambda s: F.when(s.rlike(r"\A\+?\d+\z") & (s.try_cast("int") <= 255), s.try_cast("int"))
    return (
        F.when(c.startswith("Heading"), number(F.substring(c, 8, 1 << 30)))
        .when(low.startswith("heading"), number(trim_u(F.substring(low, 8, 1 << 30))))
        .when(low == "title", 1)
        .when(low == "subtitle", 2)
    )


def font_heading(size) -> Column:
    """Heading level of a font size in hundredths of a point; 0 below 20 points."""
    size = _c(size)
    return F.when(size >= 2800, 1).when(size >= 2400, 2).when(size >= 2000, 3).otherwise(0)


def list_marker(kind, level) -> Column:
    """Indent and marker of a list item."""
    return F.concat(F.repeat(F.lit("  "), _c(level)), F.when(_c(kind) == "numbered", "1. ").otherwise("- "))
