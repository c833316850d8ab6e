"""Cells in long form -> grids.

Cells are rows (keys..., row, col, seq, value): one key value a sheet.  Everything about a sheet
happens after one shuffle on its keys: the finer groupings below reuse that partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_blank

MAX_GRID = 1_000_000


def last_written(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell: of cells at one place, the last by seq; of equal seq, the greatest value."""
    return cells.repartition(*keys).groupBy(*keys, "row", "col").agg(F.max(F.struct("seq", "value"))["value"].alias("value"))


def grids(cells: DataFrame, keys: list[str], limit: int = MAX_GRID) -> DataFrame:
    """keys..., rows: a dense array of arrays, "" where there is no cell; too large a grid is empty."""
    by_row = last_written(cells, keys).groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    sheet = by_row.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("m"), F.max("row").alias("h"), F.max(F.array_max(F.map_keys("cells"))).alias("w"))

    def row(r: Column) -> Column:
        found = F.try_element_at("m", r)
        return F.transform(F.sequence(F.lit(0), F.col("w")), lambda c: F.coalesce(F.try_element_at(found, c), F.lit("")))

    rows = F.transform(F.sequence(F.lit(0), F.col("h")), row)
    fits = (F.col("h").cast("long") + 1) * (F.col("w") + 1) <= limit
    return sheet.select(*keys, F.when(fits, rows).otherwise(F.array().cast("array<array<string>>")).alias("rows"))


def ungrid(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., row, col, value of dense rows."""
    each = sheets.select(*keys, F.posexplode("rows").alias("row", "cells"))
    return each.select(*keys, "row", F.posexplode("cells").alias("col", "value"))


def crop_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells up to the last non-empty row and between the outer non-empty columns; columns count from the first."""
    w = Window.partitionBy(*keys)
    filled = ~is_blank("value")
    edge = lambda f, c: f(F.when(filled, F.col(c))).over(w)
    bounds = cells.withColumns({"_last_row": edge(F.max, "row"), "_first": edge(F.min, "col"), "_last": edge(F.max, "col")})
    kept = bounds.where((F.col("row") <= F.col("_last_row")) & F.col("col").between(F.col("_first"), F.col("_last")))
    return kept.withColumn("col", F.col("col") - F.col("_first")).drop("_last_row", "_first", "_last")


def non_empty_sheets(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of sheets with a non-blank cell."""
    return cells.groupBy(*keys).agg(F.bool_or(~is_blank("value")).alias("_any")).where("_any").drop("_any")


def workbooks(sheets: DataFrame, doc: str, order: str) -> DataFrame:
    """doc, sheets (array of name and rows, in order) from one row a sheet."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "name", "rows")))
    return sheets.groupBy(doc).agg(F.transform(s, lambda x: F.struct(x["name"].alias("name"), x["rows"].alias("rows"))).alias("sheets"))
