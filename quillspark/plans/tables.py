"""The normalized tables of parsed documents, for queries over many files.

Each is a projection of readers.parse_all()'s records: explode, no shuffle.  All begin with doc_id and
carry their ordinals, since Spark keeps no order by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, numbers
from ..operators import render
from ..sources import readers
from . import extract


def _each(df: DataFrame, array: str, ix: str, item: str) -> DataFrame:
    return df.select("*", F.posexplode(array).alias(ix, item))


def _rels(parsed: DataFrame) -> DataFrame:
    """Relationships of all parts, in the order of their part."""
    main = [("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")]
    out = [parsed.where(f"{f} IS NOT NULL").select("doc_id", F.lit(part).alias("part"), F.posexplode(f"{f}.rels").alias("ord", "r")) for f, part in main]
    for f, parts in (("xlsx", "parts"), ("pptx", "slides")):
        inner = parsed.where(f"{f} IS NOT NULL").select("doc_id", F.explode(f"{f}.{parts}").alias("p"))
        out.append(inner.select("doc_id", F.col("p.path").alias("part"), F.posexplode("p.rels").alias("ord", "r")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.select("doc_id", "part", "ord", "r.rid", "r.target", "r.type", F.col("r.mode").alias("target_mode"))


def _blocks(parsed):
    b = _each(parsed.where("docx IS NOT NULL").select("doc_id", "docx.blocks"), "blocks", "block_ix", "b")
    level = F.coalesce(render.markup.heading_level(F.col("b.p_style")), F.lit(0))
    return b.select("doc_id", "block_ix", "b.kind", "b.p_style", level.alias("heading_level"), F.col("b.ilvl").try_cast("int").alias("list_level"), "b.image_rid")


def _runs(parsed):
    b = _each(parsed.where("docx IS NOT NULL").select("doc_id", "docx.blocks"), "blocks", "block_ix", "b")
    r = b.select("doc_id", "block_ix", F.posexplode("b.runs").alias("run_ix", "r"))
    return r.select("doc_id", "block_ix", "run_ix", "r.text", "r.bold", "r.italic", "r.link_rid")


def _table_cells(parsed):
    b = _each(parsed.where("docx IS NOT NULL").select("doc_id", "docx.blocks"), "blocks", "block_ix", "b")
    rows = b.select("doc_id", "block_ix", F.posexplode("b.rows").alias("row", "cells"))
    cells = rows.select("doc_id", "block_ix", "row", F.posexplode("cells").alias("col", "paras"))
    paras = cells.select("doc_id", "block_ix", "row", "col", F.posexplode("paras").alias("para_ix", "runs"))
    runs = paras.select("doc_id", "block_ix", "row", "col", "para_ix", F.posexplode("runs").alias("run_ix", "r"))
    return runs.select("doc_id", "block_ix", "row", "col", "para_ix", "run_ix", "r.text", "r.bold", "r.italic", "r.link_rid")


def _sheets(parsed):
    new = _each(parsed.where("xlsx IS NOT NULL").select("doc_id", "xlsx.sheets"), "sheets", "sheet_ix", "s")
    old = _each(parsed.where("xls IS NOT NULL").select("doc_id", "xls.sheets"), "sheets", "sheet_ix", "s")
    nil = lambda kind: F.lit(None).cast(kind)
    a = new.select("doc_id", "sheet_ix", "s.name", "s.rid", "s.state", nil("bigint").alias("bof_offset"), nil("int").alias("visibility"), nil("int").alias("sheet_type"))
    b = old.select("doc_id", "sheet_ix", "s.name", nil("string").alias("rid"), nil("string").alias("state"), F.col("s.offset").alias("bof_offset"), "s.visibility", "s.sheet_type")
    return a.unionByName(b)


def _shared_strings(parsed):
    strings = F.coalesce("xlsx.shared", "xls.sst")
    return parsed.select("doc_id", F.posexplode(strings).alias("sst_ix", "value"))


def _num_formats(parsed):
    f = parsed.select("doc_id", F.explode(F.coalesce("xlsx.num_formats", "xls.formats")).alias("f"))
    return f.select("doc_id", F.col("f.id").alias("num_fmt_id"), "f.code")


def _styles(parsed):
    xfs, formats = F.coalesce("xlsx.xfs", "xls.xfs"), F.coalesce("xlsx.num_formats", "xls.formats")
    both = parsed.select("doc_id", F.arrays_zip(xfs.alias("num_fmt_id"), render.date_styles(xfs, formats).alias("is_date")).alias("s"))
    return both.select("doc_id", F.posexplode("s").alias("style_ix", "s")).select("doc_id", "style_ix", "s.num_fmt_id", "s.is_date")


def _cells(parsed):
    """Cells as they stand, and `value` as it is shown."""
    x = parsed.where("xlsx IS NOT NULL").select("doc_id", "xlsx", render.date_styles(F.col("xlsx.xfs"), F.col("xlsx.num_formats")).alias("d"), F.posexplode("xlsx.parts").alias("sheet_ix", "p"))
    x = x.select("doc_id", "xlsx", "d", "sheet_ix", F.posexplode("p.rows").alias("row", "r")).select("doc_id", "xlsx", "d", "sheet_ix", "row", F.col("r.r").try_cast("int").alias("row_ref"), F.explode("r.cells").alias("c"))
    x = x.select("doc_id", "sheet_ix", "row", "row_ref", "c.col", F.col("c.type").alias("cell_type"), F.col("c.style").try_cast("int").alias("style_ix"), "c.raw", numbers.parse_number(F.col("c.raw")).alias("num"), render.xlsx_value(F.col("c"), F.col("xlsx.shared"), F.col("d")).alias("value"))
    o = parsed.where("xls IS NOT NULL").select("doc_id", "xls", render.date_styles(F.col("xls.xfs"), F.col("xls.formats")).alias("d"), F.posexplode("xls.sheets").alias("sheet_ix", "s"))
    o = o.select("doc_id", "xls", "d", "sheet_ix", F.posexplode("s.rows").alias("row", "r")).select("doc_id", "xls", "d", "sheet_ix", "row", F.explode("r").alias("c"))
    o = o.select("doc_id", "sheet_ix", "row", (F.col("row") + 1).alias("row_ref"), "c.col", F.col("c.kind").alias("cell_type"), F.col("c.xf").alias("style_ix"), F.coalesce("c.text", F.col("c.sst").cast("string")).alias("raw"), "c.num", render.xls_value(F.col("c"), F.col("xls.sst"), F.col("d")).alias("value"))
    return x.unionByName(o)


def _sheet_links(parsed):
    p = parsed.where("xlsx IS NOT NULL").select("doc_id", F.posexplode("xlsx.parts").alias("sheet_ix", "p"))
    return p.select("doc_id", "sheet_ix", F.posexplode("p.links").alias("ord", "l")).select("doc_id", "sheet_ix", "ord", "l.ref", "l.rid")


def _slides(parsed):
    return parsed.where("pptx IS NOT NULL").select("doc_id", F.explode("pptx.slides").alias("s")).select("doc_id", F.col("s.number").alias("slide_no"), "s.path")


def _paras(parsed):
    s = parsed.where("pptx IS NOT NULL").select("doc_id", F.explode(render.slides_of(F.col("pptx"))).alias("s"))
    shapes = s.select("doc_id", F.col("s.number").alias("slide_no"), F.posexplode("s.shapes").alias("shape_ix", "ps"))
    return shapes.select("doc_id", "slide_no", "shape_ix", F.posexplode("ps").alias("para_ix", "p"))


def _slide_paras(parsed):
    return _paras(parsed).select("doc_id", "slide_no", "shape_ix", "para_ix", "p.heading", "p.bullet", F.col("p.level").alias("bullet_level"))


def _slide_runs(parsed):
    r = _paras(parsed).select("doc_id", "slide_no", "shape_ix", "para_ix", F.posexplode("p.runs").alias("run_ix", "r"))
    return r.select("doc_id", "slide_no", "shape_ix", "para_ix", "run_ix", "r.text", "r.bold", "r.italic", "r.link_url")


def _pdf_pages(parsed):
    return parsed.where("pdf IS NOT NULL").select("doc_id", F.posexplode("pdf.pages").alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("page_no"), "text")


def _doc_paragraphs(parsed):
    return parsed.where("doc IS NOT NULL").select("doc_id", F.posexplode("doc.paragraphs").alias("para_ix", "text"))


def _images(parsed):
    """Readable pictures of all formats, numbered as the renderers do; mime is null for those not shown."""
    nil = F.array().cast("array<binary>")
    sheet = F.coalesce(F.flatten(F.transform("xlsx.parts", lambda p: p["pictures"])), nil)
    slide = F.coalesce(F.flatten(F.transform("pptx.slides", lambda s: s["pictures"])), nil)
    word = F.coalesce(F.transform(render.docx_images(F.col("docx")), lambda x: x["data"]), nil)
    each = parsed.where("error IS NULL").select("doc_id", F.posexplode(F.concat(word, sheet, slide)).alias("n", "data"))
    label = F.concat(F.lit("image"), (F.col("n") + 1).cast("string"))
    out = each.select("doc_id", (F.col("n") + 1).alias("image_no"), label.alias("label"), binary.image_mime("data").alias("mime"), "data")
    return out.withColumns({"inline": F.when(F.col("mime").isNotNull(), binary.image_inline("label")), "definition": F.when(F.col("mime").isNotNull(), binary.image_definition("label", "mime", "data"))})


def _errors(parsed):
    return parsed.where("error IS NOT NULL").select("doc_id", "path", F.regexp_extract("error", r"\A(\w+):", 1).alias("kind"), F.col("error").alias("message"))


TABLES = {
    "doc_format": lambda p: p.select("doc_id", "path", "format"), "rels": _rels, "blocks": _blocks, "runs": _runs, "table_cells": _table_cells, "sheets": _sheets, "shared_strings": _shared_strings,
    "num_formats": _num_formats, "styles": _styles, "cells": _cells, "sheet_links": _sheet_links, "slides": _slides, "slide_paras": _slide_paras, "slide_runs": _slide_runs, "pdf_pages": _pdf_pages,
    "doc_paragraphs": _doc_paragraphs, "images": _images, "parse_errors": _errors,
    "rendered_plain": lambda p: extract.render_parsed(p).select("doc_id", "text"), "rendered_markdown": lambda p: extract.render_parsed(p, "markdown").select("doc_id", "text"),
}


def table(parsed: DataFrame, name: str) -> DataFrame:
    return TABLES[name](parsed)


def register_views(spark: SparkSession, path: str | list[str], prefix: str = "", images: bool = False) -> DataFrame:
    """Temporary views of all tables over the files below a path.  Returns the parsed records; write these to
    a table and call views_of() on it to parse the files only once."""
    parsed = readers.parse_all(readers.detect(readers.read_files(spark, path)), images)
    views_of(parsed, prefix)
    return parsed


def views_of(parsed: DataFrame, prefix: str = "") -> None:
    for name, f in TABLES.items():
        f(parsed).createOrReplaceTempView(prefix + name)
