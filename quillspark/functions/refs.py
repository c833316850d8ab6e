"""Cell references and part paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def col_index(ref) -> Column:
    """0-based column of a reference such as "AB12"; 0 without letters."""
    letters = F.upper(F.regexp_extract(_c(ref), r"\A([A-Za-z]*)", 1))
    n = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.greatest(n - 1, F.lit(0).cast("long"))


def row_index(ref) -> Column:
    """0-based row of a reference; what follows the letters must be a number, else row 0."""
    number = F.regexp_replace(_c(ref), r"\A[A-Za-z]*", "")
    return F.greatest(F.coalesce(F.when(number.rlike(r"\A\+?\d+\z"), number.try_cast("long")), F.lit(1).cast("long")) - 1, F.lit(0).cast("long"))


def normalize_path(path) -> Column:
    """Resolves "..", drops "." and empty segments; ".." at the root is ignored."""
    return F.array_join(
        F.aggregate(
            F.split(_c(path), "/", -1),
            F.array().cast("array<string>"),
            lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((s == "") | (s == "."), a).otherwise(F.concat(a, F.array(s))),
        ),
        "/",
    )


def rels_path(part) -> Column:
    """The part that holds a part's relationships: dir/_rels/name.rels."""
    part = _c(part)
    return F.when(F.contains(part, F.lit("/")), F.regexp_replace(part, r"(?s)\A(.*)/([^/]*)\z", "$1/_rels/$2.rels")).otherwise(F.concat(F.lit("_rels/"), part, F.lit(".rels")))


def part_path(target, folder: str) -> Column:
    """A relationship target as a part path: absolute ones as they are, others inside `folder`."""
    target = _c(target)
    return F.when(F.startswith(target, F.lit("/")), F.regexp_replace(target, r"\A/+", "")).otherwise(F.concat(F.lit(folder + "/"), target))


def resolved_path(target, folder) -> Column:
    """A target relative to a folder given as a column, with ".." resolved."""
    target = _c(target)
    return F.when(F.startswith(target, F.lit("/")), F.regexp_replace(target, r"\A/+", "")).otherwise(normalize_path(F.concat(_c(folder), F.lit("/"), target)))
