"""Queries over files built from the suppliers, one file each, so that they grow with the tables; and their SQL.

They cover the paths that need whole files: pictures, record kinds of legacy workbooks, byte-wise Word text,
files on disk, the SQL functions."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import functions as F

from ..operators import render
from ..sources import biff, datasource, readers, writers
from ..streaming.ingest import shared_dir
from . import extract
from .queries import _built, s, table

_EMF = b"\x01\0\0\0"
_NL = "chr(10)"


def _files(spark, d, build):
    """doc_id (the supplier's key), path, content."""
    return _built(table(spark, d, "supplier").withColumn("k", F.col("s_suppkey")), "s_suppkey", ["k", "s_name"], build)


def _markdown(files, images=True):
    return extract.extract_from(files, "markdown", images).select(F.col("doc_id").alias("s_suppkey"), "text")


def docx_images(spark, d):
    """Paragraphs with drawings; those that can't be shown count in the numbering."""

    def build(k, name):
        drawing = lambda rid: writers.docx_paragraph(f'<w:r><w:drawing><a:blip r:embed="{rid}"/></w:drawing></w:r>')
        body = writers.docx_paragraph(writers.docx_run(name)) + (drawing("rId2") if k % 3 == 0 else "") + drawing("rId1") + (drawing("rId9") if k % 2 else "")
        return writers.docx(body, [("rId1", "image", "media/i.png"), ("rId2", "image", "media/e.emf")], {"media/i.png": writers.PNG + str(k).encode(), "media/e.emf": _EMF})

    return _markdown(_files(spark, d, build))


def xlsx_images(spark, d):
    """Sheets' pictures through drawings and their relationships, after the sheets."""

    def build(k, name):
        png = writers.PNG + str(k).encode()
        return writers.xlsx([(name, [[name]], {"picture": png}), ("Two", [["x"]], {"picture": _EMF if k % 2 else png}), ("gone", [["y"]], {"state": "hidden", "picture": png})])

    return _markdown(_files(spark, d, build))


def pptx_images(spark, d):
    """Linked runs, slides' pictures, and a slide of a picture alone."""

    def build(k, name):
        pic = lambda rid: f'<p:pic><a:blip r:embed="{rid}"/></p:pic>'
        media = {"media/a.emf": _EMF, "media/b.png": writers.PNG + str(k).encode()}
        rels = [("rId1", "hyperlink", f"http://s/{k}"), ("rId2", "image", "../media/b.png"), ("rId3", "image", "../media/a.emf")]
        return writers.pptx([[writers.pptx_paragraph(name, rid="rId1")], []], {1: rels, 2: rels}, extra={1: (pic("rId3") if k % 2 else "") + pic("rId2"), 2: pic("rId2")}, media=media)

    return _markdown(_files(spark, d, build))


def pptx_without_images(spark, d):
    """The same plan in markdown without pictures."""

    def build(k, name):
        return writers.pptx([[writers.pptx_paragraph(name, 2400), writers.pptx_paragraph(f"sub {k}", None, "buAutoNum", k % 3)]])

    return _markdown(_files(spark, d, build), False)


def _book(head: bytes, sheets: list[tuple[str, bytes]]) -> bytes:
    """A workbook of raw records: globals, and each sheet's name and cell records."""
    r = writers.record
    start = r(biff.BOF, struct.pack("<HH", 0x600, 5) + b"\0" * 12) + head
    bodies = [r(biff.BOF, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12) + body + r(biff.EOF) for _, body in sheets]
    at, bounds = len(start) + sum(12 + len(n) for n, _ in sheets) + 4, b""
    for (name, _), body in zip(sheets, bodies):
        bounds += r(biff.BOUNDSHEET, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name.encode())
        at += len(body)
    return writers.cfb.write({"Workbook": start + bounds + r(biff.EOF) + b"".join(bodies)})


def biff_records(spark, d):
    """Every cell record: LABEL, RK, MULRK, FORMULA with a number, a string record or a truth value, BOOLERR, NUMBER
    with a custom date format, and a shared string across a CONTINUE record."""

    def build(k, name):
        r, text = writers.record, f"shared {name}"
        formula = lambda row, col, result: r(biff.FORMULA, struct.pack("<HHH", row, col, 0) + result + b"\0" * 6)
        head = r(biff.FORMAT, struct.pack("<H", 165) + writers.biff_string("yyyy-mm")) + b"".join(r(biff.XF, struct.pack("<HH", 0, x) + b"\0" * 16) for x in (0, 165))
        head += r(biff.SST, struct.pack("<II", 1, 1) + struct.pack("<HB", len(text), 0) + text[:9].encode()) + r(biff.CONTINUE, b"\0" + text[9:].encode())
        body = r(biff.LABEL, struct.pack("<HHH", 0, 0, 0) + writers.biff_string(name)) + r(biff.RK, struct.pack("<HHHI", 0, 1, 0, k << 2 | 2))
        body += r(biff.MULRK, struct.pack("<HHHIHIHIH", 1, 0, 0, k << 2 | 2, 0, (k + 1) << 2 | 2, 0, (150 * k) << 2 | 3, 2)) + formula(1, 3, struct.pack("<d", k / 4))
        body += formula(2, 0, b"\0\0\0\0\0\0\xff\xff") + r(biff.STRING, writers.biff_string(f"f{k}")) + formula(2, 1, bytes([1, 0, k % 2, 0, 0, 0, 255, 255]))
        body += r(biff.BOOLERR, struct.pack("<HHHBB", 3, 0, 0, k % 3 == 0, 0)) + r(biff.NUMBER, struct.pack("<HHHd", 3, 1, 1, 40000.0 + k)) + r(biff.BOOLERR, struct.pack("<HHHBB", 3, 2, 0, 7, 1))
        return _book(head, [("S", body + r(biff.LABELSST, struct.pack("<HHHI", 4, 0, 0, 0)))])

    return extract.extract_from(_files(spark, d, build)).select(F.col("doc_id").alias("s_suppkey"), "text")


def xls_grid_limit(spark, d):
    """A sheet whose grid would pass the cell limit is empty; the others stay."""

    def build(k, name):
        label = lambda row, col, text: writers.record(biff.LABEL, struct.pack("<HHH", row, col, 0) + writers.biff_string(text))
        return _book(b"", [("A", label(0, 0, name)), ("B", label(65535, 255, "far") if k % 2 else label(99, 1, "near"))])

    return extract.extract_from(_files(spark, d, build)).select(F.col("doc_id").alias("s_suppkey"), "text")


def word_bytes(spark, d):
    """Word text of one byte a character in a code page by language, and UTF-16 text with surrogate pairs."""

    def build(k, name):
        return writers.doc(name.encode() + b" \xcf\xf0\xe8\xe2\xe5\xf2\r", 0, 0x419) if k % 2 else writers.doc(name + " \U0001f600 and \ud83d.\r")

    return extract.extract_from(_files(spark, d, build)).select(F.col("doc_id").alias("s_suppkey"), "text")


def tab_runs(spark, d):
    """Neighbouring tab lines are tables, a short one alone is a line, a long one alone is a table."""
    k = s("p_partkey")
    line = lambda *cells: F.concat_ws("\t", *[c if not isinstance(c, str) else F.lit(c) for c in cells])
    rows = F.concat_ws("\n", line(F.concat(F.lit("p|"), k), "q", "r"), F.when(F.col("p_partkey") % 3 != 0, line("a", k, "c")), F.lit(""), line("x", "y", k), F.lit(""), line("1", "2", "3", "4", "5", "6", k))
    return table(spark, d, "part").select("p_partkey", render.text_markdown(rows).alias("markdown"))


def files_from_disk(spark, d):
    """Files in folders of any depth, found, recognised and read: each supplier's page as a file of its own."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    pages = _files(spark, d, lambda k, name: writers.pdf([[name, f"key {k}"]], compress=False))
    pages.select(F.col("doc_id").alias("k"), F.col("content").cast("string").alias("value")).repartition("k").write.partitionBy("k").text(folder)
    out = extract.extract_from(readers.read_files(spark, folder, "*.txt"))
    return out.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("s_suppkey"), "format", "text")


def sql_functions(spark, d):
    """The registered functions and table function, called from SQL."""
    datasource.register(spark)
    files = _files(spark, d, lambda k, name: writers.docx(writers.docx_paragraph(writers.docx_run(name))) if k % 2 else writers.xlsx([("S", [[name, "x"], [str(k)]])]))
    files.createOrReplaceTempView("supplier_files")
    return spark.sql(
        """SELECT doc_id AS s_suppkey, document_format(content) AS format, CASE WHEN doc_id % 2 = 1 THEN document_text(content) END AS text, c.row, c.col, c.value
        FROM supplier_files LEFT JOIN LATERAL document_cells(content) c ON true"""
    )


def joined_texts(spark, d):
    """All readable documents' texts as the parts of one, in path order."""
    files = _files(spark, d, lambda k, name: writers.docx(writers.docx_paragraph(writers.docx_run(name))) if k % 4 else b"broken")
    out = extract.joined(extract.extract_from(files))
    return out.select(F.col("path").cast("long").alias("s_suppkey"), "text")


QUERIES = {
    f.__name__: f
    for f in (docx_images, xlsx_images, pptx_images, pptx_without_images, biff_records, xls_grid_limit, word_bytes, tab_runs, files_from_disk, sql_functions, joined_texts)
}

_PNG = "to_base64(from_hex('89504E470D0A1A0A0000000000000000' || hex(s_suppkey::VARCHAR)))"


def _refs(n: str) -> str:
    return f"'![][image' || {n} || ']' || {_NL} || {_NL}"


def _definition(n: str) -> str:
    return f"'[image' || {n} || ']: <data:image/png;base64,' || {_PNG} || '>' || {_NL}"


_N = "(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END)"
_M = "(CASE WHEN s_suppkey % 2 = 1 THEN 2 ELSE 1 END)"
_EVEN = "s_suppkey % 2 = 0"
_TWO = f"{_NL} || {_NL}"
_ROW3 = f"' |' || {_NL} || '| --- | --- | --- |' || {_NL} || {_NL}"
ORACLES = {
    "docx_images": f"SELECT s_suppkey, s_name || {_TWO} || {_refs(_N)} || {_definition(_N)} AS text FROM supplier",
    "xlsx_images": f"""SELECT s_suppkey, '## ' || s_name || {_TWO} || '| ' || s_name || ' |' || {_NL} || '| --- |' || {_TWO} || '## Two' || {_TWO} || '| x |' || {_NL} || '| --- |' || {_TWO} || {_refs("1")}
 || CASE WHEN {_EVEN} THEN {_refs("2")} ELSE '' END || {_definition("1")} || CASE WHEN {_EVEN} THEN {_definition("2")} ELSE '' END AS text FROM supplier""",
    "pptx_images": f"""SELECT s_suppkey, '## Slide 1' || {_TWO} || '[' || s_name || '](http://s/' || s_suppkey || ')' || {_TWO} || {_refs(_M)} || '## Slide 2' || {_TWO} || {_refs(f"({_M} + 1)")}
 || {_definition(_M)} || {_definition(f"({_M} + 1)")} AS text FROM supplier""",
    "pptx_without_images": f"SELECT s_suppkey, '## ' || s_name || {_TWO} || {_NL} || repeat('  ', (s_suppkey % 3)::INT) || '1. sub ' || s_suppkey || {_TWO} AS text FROM supplier",
    "biff_records": f"""SELECT s_suppkey, s_name || chr(9) || s_suppkey || {_NL} || s_suppkey || chr(9) || (s_suppkey + 1) || chr(9) || rtrim(rtrim(printf('%.1f', 1.5 * s_suppkey), '0'), '.') || chr(9)
 || rtrim(rtrim(printf('%.2f', s_suppkey / 4.0), '0'), '.') || {_NL} || 'f' || s_suppkey || chr(9) || CASE WHEN {_EVEN} THEN 'FALSE' ELSE 'TRUE' END || {_NL} || CASE WHEN s_suppkey % 3 = 0 THEN 'TRUE' ELSE 'FALSE' END || chr(9)
 || strftime(DATE '1899-12-30' + (40000 + s_suppkey)::INT, '%Y-%m-%d') || {_NL} || 'shared ' || s_name || {_NL} AS text FROM supplier""",
    "xls_grid_limit": f"SELECT s_suppkey, '--- A ---' || {_NL} || s_name || {_NL} || CASE WHEN {_EVEN} THEN {_NL} || '--- B ---' || {_NL} || chr(9) || 'near' || {_NL} ELSE '' END AS text FROM supplier",
    "word_bytes": f"SELECT s_suppkey, s_name || CASE WHEN {_EVEN} THEN ' ' || chr(128512) || ' and ' || chr(65533) || '.' ELSE ' Привет' END || {_NL} AS text FROM supplier",
    "tab_runs": f"""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN '| p\\|' || p_partkey || ' | q | r' || {_ROW3} || '| a | ' || p_partkey || ' | c' || {_ROW3} ELSE 'p|' || p_partkey || ' q r' || {_TWO} END
 || 'x y ' || p_partkey || {_TWO} || '| 1 | 2 | 3 | 4 | 5 | 6 |' || {_NL} || '|' || repeat(' --- |', 6) || {_NL} || '| ' || p_partkey || ' |' || repeat('  |', 5) || {_TWO} AS markdown FROM part""",
    "files_from_disk": f"SELECT s_suppkey, 'pdf' AS format, s_name || {_NL} || 'key ' || s_suppkey || {_NL} AS text FROM supplier",
    "sql_functions": f"""SELECT s_suppkey, 'docx' AS format, s_name AS text, NULL::INT AS row, NULL::INT AS col, NULL::VARCHAR AS value FROM supplier WHERE NOT {_EVEN}
 UNION ALL SELECT s_suppkey, 'xlsx', NULL, r, c, v FROM (SELECT s_suppkey, unnest([0, 0, 1]) AS r, unnest([0, 1, 0]) AS c, unnest([s_name, 'x', s_suppkey::VARCHAR]) AS v FROM supplier WHERE {_EVEN})""",
    "joined_texts": f"SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY s_suppkey) = 1 THEN '' ELSE {_NL} END || s_name || {_NL} AS text FROM supplier WHERE s_suppkey % 4 <> 0",
}
