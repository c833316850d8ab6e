"""Text functions on columns.  "Trim" is by Unicode white space, "lines" end at \\n or \\r\\n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: \s with (?U) is Unicode White_Space; \A and \z bind to the whole value.
_LEAD, _TAIL = r"(?U)\A\s+", r"(?U)\s+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: a lambda variable stands for it, which keeps nested
    expressions from growing with every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rtrim_u(c) -> Column:
    return F.regexp_replace(_c(c), _TAIL, "")


def trim_u(c) -> Column:
    return F.regexp_replace(rtrim_u(c), _LEAD, "")


def is_blank(c) -> Column:
    return trim_u(c) == ""


def lines(c) -> Column:
    """The lines of a text; a final line end adds none, an empty text has none."""
    c = _c(c)
    none = F.array().cast("array<string>")
    return F.when(c == "", none).otherwise(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n", -1))


def escape_pipe(c) -> Column:
    return F.replace(_c(c), F.lit("|"), F.lit("\\|"))


def join_ordered(order, value, sep: str = "") -> Column:
    """Aggregate: values joined in the order of `order` (a column or struct)."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def plain_paragraphs(c) -> Column:
    """Array of paragraphs -> text: right-trimmed, empty ones dropped, a blank line between."""
    joined = F.array_join(F.filter(F.transform(_c(c), rtrim_u), lambda p: p != ""), "\n\n")
    return let(joined, lambda t: F.when(t == "", "").otherwise(F.concat(t, F.lit("\n"))))


def clean_page(c) -> Column:
    """A page's text: lines right-trimmed, at most two blank lines in a row, none at either end."""
    t = F.array_join(F.transform(lines(c), rtrim_u), "\n")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\A\n+", ""), r"\n+\z", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def section_number_rest(c) -> Column:
    """What follows a leading section number ("1. ", "2.3 "); null where there is none."""
    c = _c(c)
    return F.when(c.rlike(r"\A[0-9][0-9]*\."), F.regexp_extract(c, r"(?s)\A[0-9][0-9.]* *(.*)\z", 1))


def numbered_heading(c) -> Column:
    """A markdown heading for "1.2 Title" and "Appendix N: title" lines; else null.  Lengths are in bytes."""

    def heading(t, rest):
        prefix = F.substring(t, F.lit(1), F.char_length(t) - F.char_length(rest))
        depth = F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit("."), F.lit("")))
        numbered = F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(3))), F.lit(" "), t)
        named = F.lower(t).rlike(r"\A(appendix|scenario)") & F.contains(t, F.lit(":")) & (F.octet_length(t) < 100)
        return F.when(F.octet_length(t) > 120, None).when(rest.isNotNull() & (rest != "") & ~F.endswith(rest, F.lit(".")), numbered).when(named, F.concat(F.lit("## "), t))

    return let(trim_u(c), lambda t: let(section_number_rest(t), lambda rest: heading(t, rest)))


def subheading_shape(c) -> Column:
    """A short, capitalised line of several words that doesn't end a sentence."""
    return let(trim_u(c), _is_subheading)


def _is_subheading(t: Column) -> Column:
    return F.octet_length(t).between(3, 80) & ~t.rlike(r"[.,;]\z") & t.rlike(r"[ \t]") & t.rlike(r"\A\p{IsUppercase}")


def column_count(cells) -> Column:
    """Columns of a flat cell array: a table that was run together into one line."""

    def regular(empties, n):
        gap = F.get(empties, F.lit(0)) + 1
        steps = F.forall(F.sequence(F.lit(1), F.greatest(F.size(empties) - 1, F.lit(1))), lambda i: F.coalesce(F.get(empties, i) - F.get(empties, i - 1) == gap, F.lit(False)))
        return F.when((n > 6) & (F.size(empties) >= 2) & steps & gap.between(2, 10), gap)

    def count(c):
        n = F.size(c)
        empties = F.filter(F.transform(c, lambda x, i: F.when(x == "", i)), lambda i: i.isNotNull())
        out = F.when(n <= 2, 1).when(n <= 6, n)
        found = let(empties, lambda e: regular(e, n))
        other = F.lit(None).cast("int")
        for k in (2, 5, 4, 3):
            other = F.when((n % k == 0) & (n / k >= 2), k).otherwise(other)
        return out.otherwise(F.coalesce(found, other, F.least(n, F.lit(6))))

    return let(_c(cells), count)


def tab_line_markdown(line) -> Column:
    """One tab-separated line as a markdown table, or as plain text if it has no columns."""

    def table(cells, n):
        starts = F.sequence(F.lit(0), F.size(cells) - 1, n)
        rows = F.filter(F.transform(starts, lambda i: F.slice(cells, i + 1, n)), lambda r: F.exists(r, lambda c: c != ""))
        rendered = F.transform(
            rows,
            lambda r, i: F.concat(
                F.lit("|"),
                F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit(" "), escape_pipe(F.coalesce(F.get(r, k), F.lit(""))), F.lit(" |"))), ""),
                F.lit("\n"),
                F.when(i == 0, F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n), F.lit("\n"))).otherwise(""),
            ),
        )
        return let(F.array_join(rendered, ""), lambda t: F.when(t == "", "").otherwise(F.concat(t, F.lit("\n"))))

    def either(cells, n):
        plain = let(trim_u(F.array_join(cells, " ")), lambda t: F.when(t == "", "").otherwise(F.concat(t, F.lit("\n\n"))))
        return F.when(n <= 1, plain).otherwise(table(cells, n))

    split = F.transform(F.split(trim_u(line), "\t", -1), trim_u)
    return let(split, lambda cells: let(column_count(cells), lambda n: either(cells, n)))
