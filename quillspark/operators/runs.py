"""Text runs in long form -> inline markdown, one row a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import font_heading, runs_markdown
from ..functions.text import trim_u


def collect_runs(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys..., runs (in order), n_runs.  One shuffle on the keys."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text", "bold", "italic", "link_url")))
    return runs.groupBy(*keys).agg(s.alias("runs"))


def paragraphs(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys..., markdown, plain."""
    c = collect_runs(runs, keys, order)
    return c.select(*keys, runs_markdown("runs").alias("markdown"), F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("plain"))


def headings(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., heading: from the largest font size of the runs, NULLs ignored."""
    return runs.groupBy(*keys).agg(F.coalesce(font_heading(F.max("font_size")), F.lit(0)).alias("heading"))


def shapes(paras: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys..., paragraphs (in order): struct of text, heading, bullet, level."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), trim_u("text").alias("text"), "heading", "bullet", "level")))
    return paras.groupBy(*keys).agg(s.alias("paragraphs"))
