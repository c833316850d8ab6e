"""The lookup joins of document parts, in long form.

Dictionaries (relationships, shared strings, styles) are joined by document and id; the planner picks
broadcast or shuffle by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_date_format_code, is_date_format_id


def relationships(rels: DataFrame, keys: list[str], last: bool = True) -> DataFrame:
    """keys..., rid, target: one row an id, the last (or first) by `ord`."""
    pick = F.max_by if last else F.min_by
    return rels.groupBy(*keys, "rid").agg(pick("target", "ord").alias("target"))


def hyperlinks(rels: DataFrame) -> DataFrame:
    return rels.where((F.col("rid") != "") & (F.col("target") != "") & ((F.lower("mode") == "external") | F.col("type").endswith("/hyperlink")))


def images(rels: DataFrame) -> DataFrame:
    return rels.where((F.col("rid") != "") & (F.col("target") != "") & F.col("type").endswith("/image"))


def resolve_links(rows: DataFrame, rels: DataFrame, keys: list[str]) -> DataFrame:
    """Adds link_url: the target of each row's rid, null where it is unknown."""
    targets = relationships(hyperlinks(rels), keys).withColumnRenamed("target", "link_url")
    return rows.join(targets, [*keys, "rid"], "left")


def shared_strings(cells: DataFrame, strings: DataFrame, keys: list[str]) -> DataFrame:
    """value: the string that sst_ix names, "" where there is none."""
    return cells.join(strings.withColumnRenamed("value", "_s"), [*keys, "sst_ix"], "left").withColumn("value", F.coalesce("_s", F.lit(""))).drop("_s")


def date_styles(xfs: DataFrame, formats: DataFrame, keys: list[str]) -> DataFrame:
    """Adds is_date: a built-in date format, or some custom code of that id that looks like one."""
    custom = formats.where(is_date_format_code("code")).select(*keys, "num_fmt_id").distinct().withColumn("_custom", F.lit(True))
    found = xfs.join(custom, [*keys, "num_fmt_id"], "left")
    return found.withColumn("is_date", is_date_format_id("num_fmt_id") | F.coalesce("_custom", F.lit(False))).drop("_custom")


def fold_links(value: Column, urls: Column) -> Column:
    """[value](url) once for each URL, in order; empty values stay empty."""
    return F.when(value == "", value).otherwise(F.aggregate(urls, value, lambda v, u: F.concat(F.lit("["), v, F.lit("]("), u, F.lit(")"))))
