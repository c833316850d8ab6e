"""Parsed records -> plain text, TSV and markdown.

All of it is column expressions over one document's nested record: lookups by relationship, style and
string index, densification, cropping, numbering and concatenation.  Documents are independent, so
nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import binary, markup, numbers, refs, text
from ..functions.text import let


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def links_of(rels: Column) -> Column:
    """Relationships that are hyperlinks: external, or of that type, with an id and a target."""
    return F.filter(rels, lambda r: (r["rid"] != "") & (r["target"] != "") & ((F.lower(r["mode"]) == "external") | r["type"].endswith("/hyperlink")))


def by_key(array: Column, key, value) -> Column:
    """A map of an array's elements: value(those of one key, in order) by key.  Made once a part, so that runs and
    cells look up what is theirs instead of searching the array."""

    def made(keyed):
        keys = F.array_distinct(F.transform(keyed, lambda e: e["k"]))
        return let(keys, lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: value(F.filter(keyed, lambda e: e["k"] == k)))))

    return let(F.transform(array, lambda e: F.struct(key(e).alias("k"), e.alias("e"))), made)


def targets(links: Column) -> Column:
    """Target by relationship id; of equal ids the last counts."""
    return by_key(links, lambda r: r["rid"], lambda mine: _last(mine)["e"]["target"])


def bind(runs: Column, targets: Column) -> Column:
    """Runs with their links resolved; an unknown id is no link."""
    return F.transform(runs, lambda r: F.struct(r["text"].alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), F.when(r["link_rid"].isNotNull(), F.try_element_at(targets, r["link_rid"])).alias("link_url")))


def _plain(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def table_markdown(rows: Column) -> Column:
    """Rows of cell texts (escaped here) as a table whose header is the first row; ragged rows are padded."""

    def render(rows, n):
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, text.escape_pipe), F.array_repeat(F.lit(""), n - F.size(r))), " | "), F.lit(" |\n"))
        body = F.transform(rows, lambda r, i: F.concat(line(r), F.when(i == 0, F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n), F.lit("\n"))).otherwise("")))
        return F.when(n > 0, F.concat(F.array_join(body, ""), F.lit("\n"))).otherwise("")

    return let(rows, lambda rows: let(F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)), lambda n: render(rows, n)))


# ── Word ──


def _cell_text(cell: Column, render) -> Column:
    return F.array_join(F.filter(F.transform(cell, lambda p: text.trim_u(render(p))), lambda t: t != ""), " ")


def docx_plain(record: Column) -> Column:
    def pieces(b):
        rows = F.transform(b["rows"], lambda r: text.rtrim_u(F.array_join(F.transform(r, lambda c: _cell_text(c, _plain)), "\t")))
        none = F.array().cast("array<string>")
        return F.when(b["kind"] == "paragraph", F.array(text.rtrim_u(_plain(b["runs"])))).when(b["kind"] == "table", rows).otherwise(none)

    return text.plain_paragraphs(F.flatten(F.transform(record["blocks"], pieces)))


def docx_images(record: Column) -> Column:
    """Readable images in order: block position, label, MIME type (null: can't be shown), data."""
    where = F.filter(
        F.transform(record["blocks"], lambda b, i: F.when(b["kind"] == "image", F.struct(i.alias("block"), _last(F.filter(record["media"], lambda m: m["rid"] == b["image_rid"]))["data"].alias("data")))),
        lambda x: x["data"].isNotNull(),
    )
    return F.transform(where, lambda x, i: F.struct(x["block"].alias("block"), F.concat(F.lit("image"), (i + 1).cast("string")).alias("label"), binary.image_mime(x["data"]).alias("mime"), x["data"].alias("data")))


def _definitions(images: Column) -> Column:
    return F.array_join(F.transform(F.filter(images, lambda x: x["mime"].isNotNull()), lambda x: F.concat(binary.image_definition(x["label"], x["mime"], x["data"]), F.lit("\n"))), "")


def docx_markdown(record: Column, images: bool = False) -> Column:
    pictures = docx_images(record)

    def paragraph(b, links):
        return let(text.rtrim_u(markup.runs_markdown(bind(b["runs"], links))), lambda t: styled(b, t))

    def styled(b, t):
        level = F.coalesce(markup.heading_level(b["p_style"]), F.lit(0))
        item = F.when(b["ilvl"].rlike(r"\A\+?\d+\z"), b["ilvl"].try_cast("int"))
        return (
            F.when(t == "", "")
            .when(level.between(1, 6), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t, F.lit("\n\n")))
            .when(item.between(0, 255), F.concat(F.repeat(F.lit("  "), item), F.lit("- "), t, F.lit("\n")))
            .otherwise(F.concat(t, F.lit("\n\n")))
        )

    def piece(b, i, links):
        rows = F.transform(b["rows"], lambda r: F.transform(r, lambda c: _cell_text(c, lambda p: markup.runs_markdown(bind(p, links)))))
        shown = F.filter(pictures, lambda x: (x["block"] == i) & x["mime"].isNotNull()) if images else None
        image = F.coalesce(F.concat(binary.image_inline(_first(shown)["label"]), F.lit("\n\n")), F.lit("")) if images else F.lit("")
        return F.when(b["kind"] == "paragraph", paragraph(b, links)).when(b["kind"] == "table", table_markdown(rows)).otherwise(image)

    body = let(targets(links_of(record["rels"])), lambda links: F.array_join(F.transform(record["blocks"], lambda b, i: piece(b, i, links)), ""))
    return F.concat(body, _definitions(pictures)) if images else body


# ── sheets ──


def date_styles(xfs: Column, formats: Column) -> Column:
    """For each style: whether its number format is a date, built in or by its code."""
    custom = F.transform(F.filter(formats, lambda f: numbers.is_date_format_code(f["code"])), lambda f: f["id"])
    return let(custom, lambda dates: F.transform(xfs, lambda x: numbers.is_date_format_id(x) | F.coalesce(F.array_contains(dates, x), F.lit(False))))


def xlsx_value(cell: Column, shared: Column, is_date: Column) -> Column:
    raw = F.coalesce(cell["raw"], F.lit(""))
    index = F.when(raw.rlike(r"\A\+?\d+\z"), raw.try_cast("int"))
    style = F.when(cell["style"].rlike(r"\A\+?\d+\z"), cell["style"].try_cast("int"))
    serial = F.when(F.coalesce(F.get(is_date, F.coalesce(style, F.lit(0))), F.lit(False)), numbers.parse_number(raw))
    return F.when(cell["type"] == "s", F.coalesce(F.get(shared, index), F.lit(""))).when(cell["type"].isin("", "n") & serial.isNotNull(), numbers.serial_to_iso(serial)).otherwise(raw)


def dense(cells: Column, width: Column, value) -> Column:
    """A row of cells (unique columns) as an array of `width` values, "" where there is none.  Each value is
    worked out once, and a column finds its own in a map."""
    by_column = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["col"], value(c))))
    filled = lambda m: F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.coalesce(F.try_element_at(m, k), F.lit("")))
    return F.when(width > 0, let(by_column, filled)).otherwise(F.array().cast("array<string>"))


def xlsx_sheets(record: Column) -> Column:
    """Visible sheets in workbook order with a part: name, dense rows, links applied."""

    def part_of(s):
        target = _first(F.filter(record["rels"], lambda r: r["rid"] == s["rid"]))["target"]
        return _first(F.filter(record["parts"], lambda p: p["path"] == refs.part_path(target, "xl")))

    def linked(value, i, k, urls, links):
        mine = F.coalesce(F.try_element_at(links, F.concat_ws(",", i.cast("string"), k.cast("string"))), F.array().cast("array<string>"))
        return let(value, lambda value: F.when(value == "", value).otherwise(F.aggregate(mine, value, lambda v, rid: F.coalesce(F.concat(F.lit("["), v, F.lit("]("), F.try_element_at(urls, rid), F.lit(")")), v))))

    def rows(part, is_date):
        width = F.coalesce(F.array_max(F.transform(part["rows"], lambda r: F.array_max(F.transform(r["cells"], lambda c: c["col"])))), F.lit(-1)) + 1
        grid = let(width, lambda n: F.transform(part["rows"], lambda r: dense(r["cells"], n, lambda c: xlsx_value(c, record["shared"], is_date))))
        place = lambda x: F.concat_ws(",", refs.row_index(x["ref"]).cast("string"), refs.col_index(x["ref"]).cast("string"))
        of_cell = by_key(F.filter(part["links"], lambda x: x["rid"].isNotNull()), place, lambda mine: F.transform(mine, lambda x: x["e"]["rid"]))
        with_links = lambda g: let(targets(links_of(part["rels"])), lambda urls: let(of_cell, lambda links: F.transform(g, lambda r, i: F.transform(r, lambda v, k: linked(v, i, k, urls, links)))))
        return let(grid, lambda g: F.when(F.size(part["links"]) > 0, with_links(g)).otherwise(g))

    shown = F.filter(record["sheets"], lambda s: (s["state"] != "hidden") & (s["name"] != "") & (s["rid"] != ""))
    found = F.filter(F.transform(shown, lambda s: F.struct(s["name"].alias("name"), part_of(s).alias("part"))), lambda s: s["part"].isNotNull())
    styles = date_styles(record["xfs"], record["num_formats"])
    return let(styles, lambda d: F.transform(found, lambda s: F.struct(s["name"].alias("name"), rows(s["part"], d).alias("rows"))))


def xls_value(cell: Column, sst: Column, is_date: Column) -> Column:
    number = F.when(F.coalesce(F.get(is_date, cell["xf"]), F.lit(False)), numbers.serial_to_iso(cell["num"])).otherwise(numbers.format_number(cell["num"]))
    return F.when(cell["kind"] == "sst", F.coalesce(F.get(sst, cell["sst"].cast("int")), F.lit(""))).when(cell["kind"] == "num", number).otherwise(cell["text"])


def xls_sheets(record: Column) -> Column:
    """Visible worksheets: name, dense rows at their absolute positions."""

    def rows(s, is_date):
        width = F.coalesce(F.array_max(F.transform(s["rows"], lambda r: F.array_max(F.transform(r, lambda c: c["col"])))), F.lit(-1)) + 1
        return let(width, lambda n: F.transform(s["rows"], lambda r: dense(r, n, lambda c: xls_value(c, record["sst"], is_date))))

    shown = F.filter(record["sheets"], lambda s: (s["visibility"] == 0) & (s["sheet_type"] == 0))
    return let(date_styles(record["xfs"], record["formats"]), lambda d: F.transform(shown, lambda s: F.struct(s["name"].alias("name"), rows(s, d).alias("rows"))))


def is_empty_sheet(rows: Column) -> Column:
    return F.forall(rows, lambda r: F.forall(r, text.is_blank))


def sheets_plain(sheets: Column) -> Column:
    """TSV; a header line for each sheet if there are several, empty ones included in the count."""

    def one(sheets, s, i):
        lines = F.filter(F.transform(s["rows"], lambda r: text.rtrim_u(F.array_join(r, "\t"))), lambda t: t != "")
        header = F.when(F.size(sheets) > 1, F.concat(F.when(i > 0, "\n").otherwise(""), F.lit("--- "), s["name"], F.lit(" ---\n"))).otherwise("")
        return F.when(is_empty_sheet(s["rows"]), "").otherwise(F.concat(header, F.array_join(F.transform(lines, lambda t: F.concat(t, F.lit("\n"))), "")))

    return let(sheets, lambda all_: F.array_join(F.transform(all_, lambda s, i: one(all_, s, i)), ""))


def crop(rows: Column) -> Column:
    """Without trailing empty rows and outer empty columns; interior empty ones stay.  No rows if all is empty."""
    filled = F.transform(rows, lambda r: F.filter(F.transform(r, lambda c, k: F.when(~text.is_blank(c), k)), lambda k: k.isNotNull()))

    def edges(f):
        return F.struct(F.array_max(F.transform(f, lambda ks, i: F.when(F.size(ks) > 0, i))).alias("last_row"), F.array_min(F.transform(f, F.array_min)).alias("first"), F.array_max(F.transform(f, F.array_max)).alias("last"))

    def cut(e):
        kept = F.transform(F.slice(rows, F.lit(1), e["last_row"] + 1), lambda r: F.transform(F.sequence(e["first"], e["last"]), lambda k: F.coalesce(F.get(r, k), F.lit(""))))
        return F.when(e["last_row"].isNull(), F.array().cast("array<array<string>>")).otherwise(kept)

    return let(filled, lambda f: let(edges(f), cut))


def sheets_markdown(sheets: Column) -> Column:
    def one(sheets, s):
        header = F.when(F.size(sheets) > 1, F.concat(F.lit("## "), s["name"], F.lit("\n\n"))).otherwise("")
        return let(crop(s["rows"]), lambda rows: F.when(F.size(rows) == 0, "").otherwise(F.concat(header, table_markdown(rows))))

    return let(sheets, lambda all_: F.array_join(F.transform(all_, lambda s: one(all_, s)), ""))


def _numbered(pictures: Column) -> Column:
    return F.transform(pictures, lambda d, i: F.struct(F.concat(F.lit("image"), (i + 1).cast("string")).alias("label"), binary.image_mime(d).alias("mime"), d.alias("data")))


def xlsx_images(record: Column) -> Column:
    """The inline references of all visible sheets' pictures, then their definitions."""
    shown = F.filter(record["sheets"], lambda s: (s["state"] != "hidden") & (s["name"] != "") & (s["rid"] != ""))
    path = lambda s: refs.part_path(_first(F.filter(record["rels"], lambda r: r["rid"] == s["rid"]))["target"], "xl")
    pictures = F.flatten(F.transform(shown, lambda s: F.coalesce(_first(F.filter(record["parts"], lambda p: p["path"] == path(s)))["pictures"], F.array().cast("array<binary>"))))
    images = F.filter(_numbered(pictures), lambda x: x["mime"].isNotNull())
    return let(images, lambda found: F.concat(F.array_join(F.transform(found, lambda x: F.concat(binary.image_inline(x["label"]), F.lit("\n\n"))), ""), _definitions(found)))


# ── slides ──


def slides_of(record: Column) -> Column:
    """number, shapes (arrays of paragraphs: runs, heading, bullet, level), pictures."""

    def paragraph(p, links):
        size = F.array_max(F.transform(F.filter(p["runs"], lambda r: ~r["is_field"]), lambda r: r["font_size"]))
        heading = F.coalesce(markup.font_heading(size), F.lit(0))
        marks = p["marks"]
        bullet = (
            F.when((heading > 0) | F.array_contains(marks, "buNone"), F.lit(None).cast("string"))
            .when(F.array_contains(marks, "buAutoNum"), "numbered")
            .when(F.arrays_overlap(marks, F.array(F.lit("buChar"), F.lit("buBlip"), F.lit("buFont"))), "bullet")
        )
        runs = bind(F.filter(p["runs"], lambda r: r["text"] != ""), links)
        return F.struct(runs.alias("runs"), heading.alias("heading"), bullet.alias("bullet"), p["level"].alias("level"))

    def slide(s):
        shapes = let(targets(links_of(s["rels"])), lambda links: F.transform(s["shapes"], lambda ps: F.filter(F.transform(ps, lambda p: paragraph(p, links)), lambda p: F.size(p["runs"]) > 0)))
        return F.struct(s["number"].alias("number"), F.filter(shapes, lambda ps: F.size(ps) > 0).alias("shapes"), s["pictures"].alias("pictures"))

    return F.transform(record["slides"], slide)


def slides_plain(slides: Column) -> Column:
    return let(slides, _slides_plain)


def _slides_plain(slides: Column) -> Column:
    def paragraph(p):
        marker = F.when(p["bullet"].isNull(), "").otherwise(markup.list_marker(p["bullet"], p["level"]))
        return let(text.trim_u(_plain(p["runs"])), lambda t: F.when(t == "", "").otherwise(F.concat(marker, t, F.lit("\n"))))

    def slide(s, i):
        header = F.when(F.size(slides) > 1, F.concat(F.when(i > 0, "\n").otherwise(""), F.lit("--- Slide "), s["number"].cast("string"), F.lit(" ---\n"))).otherwise("")
        return F.when(F.size(s["shapes"]) == 0, "").otherwise(F.concat(header, F.array_join(F.transform(F.flatten(s["shapes"]), paragraph), "")))

    return F.array_join(F.transform(slides, slide), "")


def shape_markdown(paragraphs: Column, many: Column) -> Column:
    """Paragraphs (text, heading, bullet, level) of one shape; a blank line closes a list."""
    return let(F.filter(paragraphs, lambda p: p["text"] != ""), lambda kept: _shape_markdown(kept, many))


def _shape_markdown(kept: Column, many: Column) -> Column:
    def piece(p, i):
        after_list = F.when(F.get(kept, i - 1)["bullet"].isNotNull() & (i > 0), "\n").otherwise("")
        level = F.when(many, F.least(p["heading"] + 2, F.lit(6))).otherwise(p["heading"])
        return (
            F.when(p["heading"].between(1, 6), F.concat(after_list, F.repeat(F.lit("#"), level), F.lit(" "), p["text"], F.lit("\n\n")))
            .when(p["bullet"].isNotNull(), F.concat(markup.list_marker(p["bullet"], p["level"]), p["text"], F.lit("\n")))
            .otherwise(F.concat(after_list, p["text"], F.lit("\n\n")))
        )

    tail = F.when(_last(kept)["bullet"].isNotNull(), "\n").otherwise("")
    return F.concat(F.array_join(F.transform(kept, piece), ""), tail)


def slides_markdown(slides: Column, images: bool = False) -> Column:
    numbered = lambda all_: _numbered(F.flatten(F.transform(all_, lambda s: s["pictures"])))
    return let(slides, lambda all_: let(numbered(all_), lambda pictures: _slides_markdown(all_, pictures, images)))


def _slides_markdown(slides: Column, pictures: Column, images: bool) -> Column:
    many = F.size(slides) > 1

    def slide(s, i):
        texts = lambda ps: F.transform(ps, lambda p: F.struct(text.trim_u(markup.runs_markdown(p["runs"])).alias("text"), p["heading"].alias("heading"), p["bullet"].alias("bullet"), p["level"].alias("level")))
        body = F.array_join(F.transform(s["shapes"], lambda ps: shape_markdown(texts(ps), many)), "\n")
        header = F.when(many, F.concat(F.lit("## Slide "), s["number"].cast("string"), F.lit("\n\n"))).otherwise("")
        out = F.concat(header, body)
        if not images:
            return F.when(F.size(s["shapes"]) == 0, "").otherwise(out)
        before = F.aggregate(F.slice(slides, F.lit(1), i), F.lit(0), lambda a, x: a + F.size(x["pictures"]))
        mine = F.filter(F.slice(pictures, before + 1, F.size(s["pictures"])), lambda x: x["mime"].isNotNull())
        refs_ = F.array_join(F.transform(mine, lambda x: F.concat(binary.image_inline(x["label"]), F.lit("\n\n"))), "")
        return F.when((F.size(s["shapes"]) == 0) & (F.size(mine) == 0), "").otherwise(F.concat(out, refs_))

    out = F.array_join(F.transform(slides, slide), "")
    return F.concat(out, _definitions(pictures)) if images else out


# ── pages and legacy Word ──


def pages_plain(pages: Column) -> Column:
    """Cleaned pages, empty ones dropped; null if none is left."""
    kept = F.filter(F.transform(pages, text.clean_page), lambda p: p != "")
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def pages_markdown(pages: Column) -> Column:
    """As pages_plain(), under "## Page N" with the original numbers if several are left."""
    kept = F.filter(F.transform(pages, lambda p, i: F.struct((i + 1).alias("number"), text.clean_page(p).alias("text"))), lambda p: p["text"] != "")
    many = lambda k: F.array_join(F.transform(k, lambda p: F.concat(F.lit("## Page "), p["number"].cast("string"), F.lit("\n\n"), p["text"])), "\n")
    return let(kept, lambda k: F.when(F.size(k) == 1, _first(k)["text"]).when(F.size(k) > 1, many(k)))


def text_markdown(c: Column) -> Column:
    """Structure inferred from plain text: tab-separated runs of lines, numbered headings, subheadings."""
    return let(text.lines(c), lambda raw: let(F.transform(raw, text.trim_u), lambda trimmed: _lines_markdown(raw, trimmed)))


def _lines_markdown(raw: Column, trimmed: Column) -> Column:
    tabbed = lambda i: F.coalesce(F.contains(F.get(trimmed, i), F.lit("\t")), F.lit(False))
    blank = lambda i: F.coalesce(F.get(trimmed, i), F.lit("")) == ""

    def piece(t, i):
        line = F.get(raw, i)
        tabs = F.char_length(line) - F.char_length(F.replace(line, F.lit("\t"), F.lit("")))
        run = (tabbed(i - 1) & (i > 0)) | tabbed(i + 1)
        bare = text.trim_u(F.replace(t, F.lit("\t"), F.lit(" ")))
        alone = ((i == 0) | blank(i - 1)) & blank(i + 1)
        block = F.when(text.subheading_shape(t) & alone, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
        return (
            F.when(t == "", "")
            .when(tabbed(i) & (run | (tabs >= 5)), text.tab_line_markdown(line))
            .when(tabbed(i), let(bare, lambda b: F.when(b == "", "").otherwise(F.concat(b, F.lit("\n\n")))))
            .otherwise(F.concat(F.coalesce(text.numbered_heading(t), block), F.lit("\n\n")))
        )

    return F.array_join(F.transform(trimmed, piece), "")
