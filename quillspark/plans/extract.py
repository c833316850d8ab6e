"""Files in, text out: the whole converter as one plan, one pass over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render
from ..sources import readers

NO_TEXT = "PDF contains no extractable text"


def _plain() -> dict[str, Column]:
    c = F.col
    return {
        "docx": render.docx_plain(c("docx")),
        "xlsx": render.sheets_plain(render.xlsx_sheets(c("xlsx"))),
        "xls": render.sheets_plain(render.xls_sheets(c("xls"))),
        "pptx": render.slides_plain(render.slides_of(c("pptx"))),
        "doc": render.text.plain_paragraphs(c("doc.paragraphs")),
        "pdf": render.pages_plain(c("pdf.pages")),
    }


def _markdown(images: bool) -> dict[str, Column]:
    c = F.col
    xlsx = render.sheets_markdown(render.xlsx_sheets(c("xlsx")))
    return {
        "docx": render.docx_markdown(c("docx"), images),
        "xlsx": F.concat(xlsx, render.xlsx_images(c("xlsx"))) if images else xlsx,
        "xls": render.sheets_markdown(render.xls_sheets(c("xls"))),
        "pptx": render.slides_markdown(render.slides_of(c("pptx")), images),
        "doc": render.text_markdown(render.text.plain_paragraphs(c("doc.paragraphs"))),
        "pdf": render.pages_markdown(c("pdf.pages")),
    }


def render_parsed(parsed: DataFrame, mode: str = "plain", images: bool = False) -> DataFrame:
    """doc_id, path, format, text, error from readers.parse_all()."""
    if mode not in ("plain", "markdown"):
        raise ValueError("mode is plain or markdown")
    chosen = _plain() if mode == "plain" else _markdown(images)
    text = F.lit(None).cast("string")
    for fmt, column in chosen.items():
        text = F.when((F.col("format") == fmt) & F.col("error").isNull(), column).otherwise(text)
    out = parsed.select("doc_id", "path", "format", text.alias("text"), "error")
    empty = F.col("error").isNull() & F.col("text").isNull() & (F.col("format") == "pdf")
    return out.withColumn("error", F.when(empty, NO_TEXT).otherwise(F.col("error")))


def extract(spark: SparkSession, path: str | list[str], mode: str = "plain", images: bool = False) -> DataFrame:
    """Text of every supported file below a path; files that can't be read have `error` instead."""
    return extract_from(readers.read_files(spark, path), mode, images)


def extract_from(files: DataFrame, mode: str = "plain", images: bool = False) -> DataFrame:
    """As extract(), from a DataFrame of doc_id, path, content (binary)."""
    return render_parsed(readers.parse_all(readers.detect(files), images), mode, images)


def joined(extracted: DataFrame) -> DataFrame:
    """path, text: the readable documents' texts in path order, each after the first with a line break before it,
    so that they follow each other as one text.  They stay rows: sorted by ranges, no task holds them all."""
    ok = extracted.where("error IS NULL").select("path", "text")
    first = ok.agg(F.min("path").alias("first"))
    apart = ok.join(F.broadcast(first), ok["path"] > first["first"], "left")
    return apart.select("path", F.concat(F.when(F.col("first").isNotNull(), "\n").otherwise(""), "text").alias("text")).orderBy("path")
