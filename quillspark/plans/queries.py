"""Queries over the driver's tables, one for each operator: name -> function of (spark, sf_dir).

Each reads whole tables, derives the operator's input from them with plain expressions, and returns flat
columns; oracles.py has the same in DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import binary, markup, numbers, refs, text
from ..operators import lookups, render, runs, sheets
from ..sources import readers, writers
from ..streaming.ingest import stream_table
from . import extract


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ── text ──


def _paragraph_text() -> Column:
    return text.plain_paragraphs(text.lines(F.coalesce("text", F.lit(""))))


def doc_markdown(spark, d):
    return table(spark, d, "documents").withColumn("plain", _paragraph_text()).select("doc_id", render.text_markdown(F.col("plain")).alias("markdown"))


def doc_plain_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", _paragraph_text().alias("plain"))


def doc_subheadings(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
    return lines.where(text.subheading_shape("line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.trim_u("line").alias("line"))


def line_neighbours(spark, d):
    """Blank neighbours of each line in line mode, as windows over one shuffle by document."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.coalesce("text", F.lit("")))).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    blank = lambda f: F.coalesce(text.trim_u(f("line").over(w)), F.lit("")) == ""
    return lines.withColumns({"before": blank(F.lag), "after": blank(F.lead)}).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("before").alias("blank_before"), F.count_if("after").alias("blank_after"))


def section_headings(spark, d):
    named = table(spark, d, "part").select(
        F.col("p_partkey").alias("k"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(s(F.col("p_size")), F.lit("."), s(F.col("p_partkey") % 7), F.lit(" "), "p_name"))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Appendix "), s("p_size"), F.lit(": "), "p_name"))
        .when(F.col("p_partkey") % 4 == 2, F.concat(s("p_size"), F.lit(". "), "p_name", F.lit(".")))
        .otherwise(F.concat(s("p_size"), F.lit(" "), "p_name"))
        .alias("line"),
    )
    return named.select("k", "line", text.numbered_heading("line").alias("heading"), text.section_number_rest("line").alias("rest"))


def _tab_cells() -> Column:
    return F.transform(F.sequence(F.lit(1), F.col("p_size") % 14 + 1), lambda i: F.when(i % (F.col("p_partkey") % 4 + 3) == 0, "").otherwise(F.concat(F.lit("v|"), s(i))))


def tab_columns(spark, d):
    return table(spark, d, "part").select("p_partkey", text.column_count(_tab_cells()).cast("long").alias("n_cols"))


def tab_tables(spark, d):
    return table(spark, d, "part").select("p_partkey", text.tab_line_markdown(F.array_join(_tab_cells(), "\t")).alias("markdown"))


def _gappy_text() -> Column:
    return F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat(F.lit(" "), F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 1).cast("int"))))


def clean_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_page(_gappy_text()).alias("page"))


def blank_runs(spark, d):
    """The blank-run counter as a window: islands of blank lines, of which two are kept."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(_gappy_text())).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    island = F.sum(F.when(text.rtrim_u("line") != "", 1).otherwise(0)).over(w)
    numbered = lines.withColumn("blank", text.rtrim_u("line") == "").withColumn("island", island)
    ranked = numbered.withColumn("k", F.sum(F.col("blank").cast("int")).over(Window.partitionBy("doc_id", "island").orderBy("n")))
    return ranked.groupBy("doc_id").agg(F.count_if(~F.col("blank") | (F.col("k") <= 2)).alias("kept_lines"), F.count("*").alias("lines"))


def _turn_pages(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, " \n").otherwise(F.coalesce("text", F.lit(""))).alias("page"))
    s_ = F.array_sort(F.collect_list(F.struct("turn", "page")))
    return turns.groupBy("conv_id").agg(F.transform(s_, lambda x: x["page"]).alias("pages"))


def pdf_pages_plain(spark, d):
    return _turn_pages(spark, d).select("conv_id", render.pages_plain(F.col("pages")).alias("text"))


def pdf_page_headings(spark, d):
    return _turn_pages(spark, d).select("conv_id", render.pages_markdown(F.col("pages")).alias("text"))


# ── sheets ──


def _supplier_cells(spark, d):
    """One workbook a region, one sheet a nation, one row a supplier; every fifth name is blank."""
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")) - 1
    sup = sup.select("n_regionkey", "n_nationkey", "n_name", "s_suppkey", "s_name", "s_acctbal", row.alias("row"))
    values = F.array(F.lit(" "), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.replace("s_name", F.lit("#"), F.lit("|"))), F.lit(""), s("s_suppkey"), F.lit("  "))
    return sup.select("n_regionkey", "n_nationkey", "n_name", "row", F.posexplode(values).alias("col", "value"), F.col("s_suppkey").alias("seq"))


def _workbooks(spark, d):
    grids = sheets.grids(_supplier_cells(spark, d), ["n_regionkey", "n_nationkey", "n_name"]).withColumnRenamed("n_name", "name")
    return sheets.workbooks(grids, "n_regionkey", "n_nationkey")


def sheet_tsv(spark, d):
    return _workbooks(spark, d).select("n_regionkey", render.sheets_plain(F.col("sheets")).alias("tsv"))


def sheet_markdown(spark, d):
    return _workbooks(spark, d).select("n_regionkey", render.sheets_markdown(F.col("sheets")).alias("markdown"))


def _line_cells(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 6).cast("int").alias("col"), F.col("l_partkey").alias("seq"), F.when(F.col("l_returnflag") == "R", s("l_partkey")).otherwise(" ").alias("value"))


def sheet_crop(spark, d):
    return sheets.crop_cells(_line_cells(spark, d), ["l_orderkey"]).select("l_orderkey", "row", F.col("col").cast("long").alias("col"), "value", "seq")


def sheet_skip_empty(spark, d):
    return sheets.non_empty_sheets(_line_cells(spark, d), ["l_orderkey"])


def grid_densify(spark, d):
    cells = sheets.ungrid(sheets.grids(_line_cells(spark, d), ["l_orderkey"]), ["l_orderkey"])
    return cells.select("l_orderkey", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


def sst_lookup(spark, d):
    cells = table(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), "l_orderkey", "l_linenumber", (F.col("l_partkey") * 2 - F.col("l_linenumber")).alias("sst_ix"))
    strings = table(spark, d, "part").select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("sst_ix"), F.col("p_name").alias("value"))
    return lookups.shared_strings(cells, strings, ["doc_id"]).groupBy("l_orderkey").agg(F.count_if(F.col("value") != "").alias("n_found"), F.max("value").alias("last_value"))


def style_dates(spark, d):
    xfs = table(spark, d, "part").select(F.col("p_partkey").alias("style_ix"), F.lit(0).alias("doc_id"), "p_size", (F.col("p_size") + 150).alias("num_fmt_id"))
    xfs = xfs.withColumn("num_fmt_id", F.when(F.col("style_ix") % 2 == 0, F.col("p_size")).otherwise(F.col("num_fmt_id")))
    formats = spark.range(150, 201).select(F.lit(0).alias("doc_id"), F.col("id").cast("int").alias("num_fmt_id"), F.when(F.col("id") % 3 == 0, "yyyy-mm-dd").when(F.col("id") % 3 == 1, "#,##0.00").otherwise('"day" 0').alias("code"))
    return lookups.date_styles(xfs, formats, ["doc_id"]).select("style_ix", "num_fmt_id", "is_date")


def link_cells(spark, d):
    """Links of a cell nest, in order; empty cells get none."""
    cells = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("value"))
    links = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("http://p/"), s(x["l_partkey"]))).alias("urls"))
    joined = cells.join(links, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", lookups.fold_links(F.col("value"), F.coalesce("urls", F.array().cast("array<string>"))).alias("value"))


# ── relationships and links ──


def _anchors(spark, d):
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    each = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("ord", "a"))
    return each.select("page_id", "ord", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("target"), F.regexp_extract("a", r">([^<]*)<", 1).alias("text"))


def _anchor_rels(spark, d):
    """Relationships made of the pages' links: ids repeat, every third is an image, some are external only by mode."""
    a = _anchors(spark, d)
    kind = F.when(F.col("ord") % 3 == 0, "urn:r/image").when(F.col("ord") % 3 == 1, "urn:r/hyperlink").otherwise("urn:r/other")
    return a.select("page_id", "ord", F.concat(F.lit("rId"), s(F.col("ord") % 4)).alias("rid"), "target", kind.alias("type"), F.when(F.col("ord") % 2 == 0, "EXTERNAL").otherwise("").alias("mode"))


def rels_resolve(spark, d):
    rels = _anchor_rels(spark, d)
    rows = rels.select("page_id", "rid").distinct()
    out = lookups.resolve_links(rows, rels, ["page_id"])
    first = lookups.relationships(lookups.images(rels), ["page_id"], last=False).withColumnRenamed("target", "image_target")
    return out.join(first, ["page_id", "rid"], "left").select("page_id", "rid", "link_url", "image_target")


def hyperlinks_markdown(spark, d):
    a = _anchors(spark, d).withColumn("md", markup.link(F.col("text"), F.col("target")))
    return a.groupBy("page_id").agg(text.join_ordered("ord", "md", " ").alias("markdown"))


def _line_runs(spark, d):
    url = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("http://s/"), s(F.col("l_suppkey") % 3)))
    words = F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat(F.lit("p"), s("l_partkey")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").select("l_orderkey", order.alias("ord"), words.alias("text"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_linestatus") == "F").alias("italic"), url.alias("link_url"))


def runs_grouped(spark, d):
    return runs.paragraphs(_line_runs(spark, d), ["l_orderkey"], "ord").select("l_orderkey", "markdown", "plain")


def slide_heading_levels(spark, d):
    r = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("p_size") * 60).alias("font_size"))
    return runs.headings(r, ["l_orderkey"])


def slides_markdown(spark, d):
    """Orders as shapes of paragraphs: headings, bullets and numbered items by the supplier's key."""
    k = F.col("l_suppkey") % 5
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, d, "lineitem").select("l_orderkey", order.alias("ord"), F.when(F.col("l_linenumber") == 5, " ").otherwise(F.concat(F.lit("t"), s("l_partkey"))).alias("text"), F.when(k == 0, 2).otherwise(0).alias("heading"), F.when(k == 1, "bullet").when(k == 2, "numbered").alias("bullet"), (F.col("l_linenumber") % 3).alias("level"))
    return runs.shapes(p, ["l_orderkey"], "ord").select("l_orderkey", render.shape_markdown(F.col("paragraphs"), F.col("l_orderkey") % 2 == 0).alias("markdown"))


def bullets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(markup.list_marker(F.when(F.col("p_partkey") % 2 == 0, "numbered").otherwise("bullet"), F.col("p_size") % 4), F.col("p_name")).alias("item"))


def heading_styles(spark, d):
    style = F.element_at(F.array(*[F.lit(x) for x in ("Heading", "heading ", "heading", "Title", "Subtitle", "Heading ", "Normal")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    made = F.when(F.col("p_partkey") % 7 < 3, F.concat(style, s(F.col("p_size") % 12))).otherwise(style)
    return table(spark, d, "part").select("p_partkey", made.alias("style"), markup.heading_level(made).alias("level"))


def field_urls(spark, d):
    code = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(' HYPERLINK "'), "url", F.lit('" \\l "b"'))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("hyperlink "), "url", F.lit(" \\h"))).when(F.col("page_id") % 4 == 2, F.lit("PAGE")).otherwise(F.lit('HYPERLINK \\l "b"'))
    return table(spark, d, "pages").select("page_id", markup.hyperlink_url(code).alias("url"))


# ── numbers, dates, references ──


def serial_to_iso(spark, d):
    o = table(spark, d, "orders")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double") + (F.col("o_orderkey") % 24).cast("double") / 24.0
    return o.select("o_orderkey", numbers.serial_to_iso(serial).alias("iso"))


def serial_edges(spark, d):
    v = F.when(F.col("id") < 100, F.col("id").cast("double")).otherwise(F.col("id").cast("double") * 30011.0)
    return spark.range(0, 200).select("id", numbers.serial_to_iso(v - 1).alias("iso"))


def serial_time(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", numbers.hms((F.col("event_id") % 86400).cast("double") / 86400.0).alias("time"))


def date_format_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.is_date_format_id("p_size").alias("is_date"))


def date_format_strings(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("yyyy-mm-dd", "#,##0.00", "General", '"day"0', "\\d", "hh:mm:ss", "mm:ss.0", '"x"m/d', "0%", "[Red]General", '"open d')]), (F.col("p_partkey") % 11 + 1).cast("int"))
    made = F.concat(code, F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(' "'), "p_type", F.lit('"'))))
    return table(spark, d, "part").select("p_partkey", numbers.is_date_format_code(made).alias("is_date"))


def format_number(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", numbers.format_number(F.col("l_quantity")).alias("quantity"), numbers.format_number(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).alias("price"))


def rk_decode(spark, d):
    li = table(spark, d, "lineitem")
    whole = F.shiftleft(F.col("l_quantity").cast("long"), 2).bitwiseOR(F.lit(2).cast("long"))
    cents = F.shiftleft(F.round(F.col("l_extendedprice") * 100).cast("long") % 500000000, 2).bitwiseOR(F.lit(3).cast("long"))
    high = (F.lit(0x40590000) + F.col("l_linenumber") * 65536).cast("long")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", numbers.rk_value(whole).alias("whole"), numbers.rk_value(cents).alias("cents"), numbers.rk_value(high).alias("double"))


def _refs() -> Column:
    n = F.col("p_partkey") - 1
    two = F.concat(F.when(n >= 26, F.char(F.floor(n / 26).cast("int") % 27 + 64)).otherwise(""), F.char((n % 26 + 65).cast("int")))
    return F.concat(F.when(F.col("p_size") % 2 == 0, F.lower(F.replace(two, F.lit("@"), F.lit("")))).otherwise(F.replace(two, F.lit("@"), F.lit(""))), F.when(F.col("p_size") % 10 == 0, F.lit("1:B2")).otherwise(s("p_size")))


def col_refs(spark, d):
    return table(spark, d, "part").select("p_partkey", _refs().alias("ref"), refs.col_index(_refs()).alias("col"))


def row_refs(spark, d):
    return table(spark, d, "part").select("p_partkey", refs.row_index(_refs()).alias("row"))


def zip_paths(spark, d):
    path = F.concat(F.lit("ppt/slides/../"), F.regexp_replace("url", "^[a-z]*:/", "."), F.lit("/../x.png"))
    return table(spark, d, "pages").select("page_id", refs.normalize_path(path).alias("path"), refs.rels_path(path).alias("rels"), refs.part_path(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//"), path)).otherwise(path), "xl").alias("part"))


def lid_codepage(spark, d):
    return spark.range(0, 4096).select(F.col("id").alias("lid"), binary.language_page("id").cast("long").alias("page"))


def codepage_decode(spark, d):
    b = F.unhex(F.lpad(F.hex("id"), 2, "0"))
    return spark.range(0, 256).select("id", binary.decode_page(b, 1252).alias("cp1252"), binary.decode_page(b, 28595).alias("iso5"))


# ── signatures ──

_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425056", "424D0000", "3C7376672F3E", "3C3F786D6C3E", "0100", "D7CDC69A")


def _head(column) -> Column:
    return F.unhex(F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (column % len(_HEADS) + 1).cast("int")))


def image_mime(spark, d):
    return table(spark, d, "part").select("p_partkey", binary.image_mime(_head(F.col("p_partkey"))).alias("mime"))


def image_refs(spark, d):
    """Numbering counts readable images, shown or not, in order; those that can't be shown then go."""
    one = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), "p_partkey", _head(F.col("p_partkey")).alias("data"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_partkey"))
    named = one.withColumns({"label": F.concat(F.lit("image"), s(number)), "mime": binary.image_mime("data")}).where("mime IS NOT NULL")
    return named.select("doc_id", "p_partkey", binary.image_inline("label").alias("inline"), binary.image_definition("label", "mime", "data").alias("definition"))


def detect_format(spark, d):
    """Signatures and the size guard, on synthetic heads; containers are looked into in the round trips."""
    head = F.element_at(F.array(*[F.lit(h) for h in (binary.OLE2, binary.PDF + "2D312E37", binary.ZIP, "00", "D0CF11E0")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", binary.container(F.unhex(head)).alias("kind"))


# ── round trips: files are built by the writers and read by the engine ──


def _built(df: DataFrame, key: str, columns: list[str], build) -> DataFrame:
    """doc_id, path, content: one file a row, built from the row's columns on the executors."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in rows], pa.int64()), pa.array([f"{r[key]:08d}" for r in rows]), pa.array([build(*(r[c] for c in columns)) for r in rows], pa.binary())], ["doc_id", "path", "content"])

    return df.select(F.col(key).cast("long").alias(key), *columns).mapInArrow(run, "doc_id long, path string, content binary")


def _nation_sheet(spark, d):
    sup = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("rows"))
    return table(spark, d, "nation").join(sup, F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey", "n_name", "rows")


def _rows(spark, d, fmt, build):
    files = _built(_nation_sheet(spark, d), "n_nationkey", ["n_name", "rows"], build)
    return readers.parse(files, fmt)


def xlsx_roundtrip(spark, d):
    def build(name, rows):
        shared = [r["s_name"] for r in rows]
        return writers.xlsx([(name, [[r["s_suppkey"], ("s", i), (float(r["s_suppkey"]) + 40000, 1)] for i, r in enumerate(rows)]), ("gone", [["x"]], {"state": "hidden"})], shared, {170: "yyyy-mm-dd"}, [0, 170])

    p = _rows(spark, d, "xlsx", build).select("doc_id", F.explode(render.xlsx_sheets(F.col("record"))).alias("s"))
    return p.select("doc_id", "s.name", F.posexplode("s.rows").alias("row", "r")).select(F.col("doc_id").alias("n_nationkey"), "name", F.col("r")[0].alias("suppkey"), F.col("r")[1].alias("supplier"), F.col("r")[2].alias("day"))


def xls_roundtrip(spark, d):
    def build(name, rows):
        return writers.xls([(name, [[float(r["s_suppkey"]), r["s_name"], (float(r["s_suppkey"]) + 40000, 1), r["s_suppkey"] % 2 == 0] for r in rows]), ("gone", [["x"]], 2)], [0, 14])

    p = _rows(spark, d, "xls", build).select("doc_id", F.explode(render.xls_sheets(F.col("record"))).alias("s"))
    return p.select("doc_id", "s.name", F.posexplode("s.rows").alias("row", "r")).select(F.col("doc_id").alias("n_nationkey"), "name", F.col("r")[0].alias("suppkey"), F.col("r")[1].alias("supplier"), F.col("r")[2].alias("day"), F.col("r")[3].alias("even"))


def docx_roundtrip(spark, d):
    def build(name, rows):
        link = '<w:hyperlink r:id="rId1">' + writers.docx_run("all", True) + writers.docx_run(" of them") + "</w:hyperlink>"
        table_ = writers.docx_table([["Key", "Name|s"], *([str(r["s_suppkey"]), r["s_name"]] for r in rows)])
        return writers.docx(writers.docx_paragraph(writers.docx_run(name), "Heading2") + writers.docx_paragraph(writers.docx_run("item"), level=1) + writers.docx_paragraph(link) + table_, [("rId1", "hyperlink", "http://s/")])

    return _rows(spark, d, "docx", build).select(F.col("doc_id").alias("n_nationkey"), render.docx_plain(F.col("record")).alias("plain"), render.docx_markdown(F.col("record")).alias("markdown"))


def pptx_roundtrip(spark, d):
    def build(name, rows):
        return writers.pptx([[writers.pptx_paragraph(name, 2800)], [writers.pptx_paragraph("lost")], ["".join(writers.pptx_paragraph(r["s_name"], None, "buAutoNum" if r["s_suppkey"] % 2 else "buChar", r["s_suppkey"] % 3) for r in rows)]], missing=(2,))

    slides = render.slides_of(F.col("record"))
    return _rows(spark, d, "pptx", build).select(F.col("doc_id").alias("n_nationkey"), render.slides_plain(slides).alias("plain"), render.slides_markdown(slides).alias("markdown"))


def doc_roundtrip(spark, d):
    def build(name, rows):
        return writers.doc(name + " Report\r" + "".join(f'{r["s_name"]} is \x13HYPERLINK "http://s/{r["s_suppkey"]}"\x14here\x15.\r' for r in rows))

    plain = text.plain_paragraphs(F.col("record.paragraphs"))
    return _rows(spark, d, "doc", build).select(F.col("doc_id").alias("n_nationkey"), plain.alias("plain"), render.text_markdown(plain).alias("markdown"))


def pdf_roundtrip(spark, d):
    def build(name, rows):
        return writers.pdf([[name], [], *([r["s_name"], "  ", f"({r['s_suppkey']})"] for r in rows)])

    return _rows(spark, d, "pdf", build).select(F.col("doc_id").alias("n_nationkey"), render.pages_markdown(F.col("record.pages")).alias("markdown"))


def parse_errors(spark, d):
    """Broken files are rows with an error: one kind a remainder of the key."""

    def build(name):
        return {
            0: b"", 1: b"PK\x03\x04" + name.encode(), 2: writers.cfb.write({"Other": b"x"}), 3: writers.doc("x", 0x1100),
            4: writers.xls([("A", [["a"]])], encrypted=True), 5: writers.pdf([[]]), 6: writers.docx(writers.docx_paragraph(writers.docx_run(name))),
        }[len(name) % 7]

    files = _built(table(spark, d, "nation"), "n_nationkey", ["n_name"], build)
    out = extract.extract_from(files)
    return out.select(F.col("doc_id").alias("n_nationkey"), "format", "text", F.col("error").isNotNull().alias("failed"))


def extract_all(spark, d):
    """Mixed formats through one plan: each nation's name in a file of the format that its key picks."""

    def build(key, name):
        return [
            lambda: writers.docx(writers.docx_paragraph(writers.docx_run(name))), lambda: writers.xlsx([("S", [[name]])]), lambda: writers.pptx([[writers.pptx_paragraph(name)]]),
            lambda: writers.xls([("S", [[name]])]), lambda: writers.doc(name + "\r"), lambda: writers.pdf([[name]]),
        ][key % 6]()

    files = _built(table(spark, d, "nation").withColumn("k", F.col("n_nationkey")), "n_nationkey", ["k", "n_name"], build)
    return extract.extract_from(files).select(F.col("doc_id").alias("n_nationkey"), "format", "text")


def stream_subheadings(spark, d):
    """doc_subheadings over a file stream, run to its end."""
    schema = spark.read.parquet(f"{d}/documents.parquet").schema

    def transform(docs: DataFrame) -> DataFrame:
        lines = docs.select("doc_id", F.posexplode(text.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
        return lines.where(text.subheading_shape("line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.trim_u("line").alias("line"))

    return stream_table(spark, d, "documents.parquet", schema, transform, "subheadings")


QUERIES = {
    f.__name__: f
    for f in (
        doc_markdown, doc_plain_paragraphs, doc_subheadings, line_neighbours, section_headings, tab_columns, tab_tables, clean_pages, blank_runs, pdf_pages_plain, pdf_page_headings,
        sheet_tsv, sheet_markdown, sheet_crop, sheet_skip_empty, grid_densify, sst_lookup, style_dates, link_cells, rels_resolve, hyperlinks_markdown, runs_grouped, slide_heading_levels,
        slides_markdown, bullets, heading_styles, field_urls, serial_to_iso, serial_edges, serial_time, date_format_ids, date_format_strings, format_number, rk_decode, col_refs, row_refs,
        zip_paths, lid_codepage, codepage_decode, image_mime, image_refs, detect_format, xlsx_roundtrip, xls_roundtrip, docx_roundtrip, pptx_roundtrip, doc_roundtrip, pdf_roundtrip,
        parse_errors, extract_all, stream_subheadings,
    )
}
