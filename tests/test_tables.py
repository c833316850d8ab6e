"""The normalized tables."""

import pytest

from quillspark.plans import tables
from quillspark.sources import readers
from quillspark.sources import writers as w


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    P, R = w.docx_paragraph, w.docx_run
    files = [
        w.docx(P(R("T"), "Heading2") + P('<w:hyperlink r:id="rId1">' + R("l", True) + "</w:hyperlink>", None, 1) + w.docx_table([["a", "b"], ["c"]]) + '<w:p><w:r><w:drawing><a:blip r:embed="rId2"/></w:drawing></w:r></w:p>', [("rId1", "hyperlink", "http://x"), ("rId2", "image", "media/i.png")], {"media/i.png": w.PNG}),
        w.xlsx([("S", [[("s", 0), (45292, 1)], [None, 2.5]], {"links": [("A1", "http://l")]}), ("H", [["h"]], {"state": "hidden"})], ["one"], {165: "yyyy"}, [0, 165]),
        w.pptx([[w.pptx_paragraph("Big", 2800) + w.pptx_paragraph("b", None, "buChar", 1)]]), w.xls([("X", [["v", 1.5, (45292, 1)]]), ("Z", [["z"]], 1)], [0, 14]), w.doc("p one\rp two\r"), w.pdf([["x"], ["y"]]), b"junk",
    ]
    at = tmp_path_factory.mktemp("parsed")
    df = spark.createDataFrame([(i, f"f{i}", bytearray(b)) for i, b in enumerate(files)], "doc_id long, path string, content binary")
    readers.parse_all(readers.detect(df), images=True).write.parquet(str(at / "t"))  # records survive Parquet
    return spark.read.parquet(str(at / "t"))


def rows(parsed, name, *columns, order):
    return [tuple(r) for r in tables.table(parsed, name).orderBy(*order).select(*columns).collect()]


def test_word_tables(parsed):
    assert rows(parsed, "blocks", "kind", "heading_level", "list_level", order=["block_ix"]) == [("paragraph", 2, None), ("paragraph", 0, 1), ("table", 0, None), ("paragraph", 0, None), ("image", 0, None)]
    assert rows(parsed, "runs", "block_ix", "text", "bold", "link_rid", order=["block_ix", "run_ix"]) == [(0, "T", False, None), (1, "l", True, "rId1")]
    assert rows(parsed, "table_cells", "row", "col", "text", order=["row", "col"]) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    assert rows(parsed, "doc_paragraphs", "para_ix", "text", order=["para_ix"]) == [(0, "p one"), (1, "p two"), (2, "")]
    assert rows(parsed, "images", "doc_id", "label", "mime", "inline", order=["doc_id"]) == [(0, "image1", "image/png", "![][image1]")]
    assert ("word/document.xml", "rId1", "http://x", "External") in rows(parsed, "rels", "part", "rid", "target", "target_mode", order=["doc_id", "part", "ord"])


def test_sheet_tables(parsed):
    assert rows(parsed, "sheets", "doc_id", "name", "state", "visibility", order=["doc_id", "sheet_ix"]) == [(1, "S", "", None), (1, "H", "hidden", None), (3, "X", None, 0), (3, "Z", None, 1)]
    got = rows(parsed, "cells", "doc_id", "sheet_ix", "row", "col", "value", order=["doc_id", "sheet_ix", "row", "col"])
    assert got == [(1, 0, 0, 0, "one"), (1, 0, 0, 1, "2024-01-01"), (1, 0, 1, 1, "2.5"), (1, 1, 0, 0, "h"), (3, 0, 0, 0, "v"), (3, 0, 0, 1, "1.5"), (3, 0, 0, 2, "2024-01-01")]
    assert rows(parsed, "styles", "doc_id", "num_fmt_id", "is_date", order=["doc_id", "style_ix"]) == [(1, 0, False), (1, 165, True), (3, 0, False), (3, 14, True)]
    assert rows(parsed, "shared_strings", "doc_id", "value", order=["doc_id", "sst_ix"])[0] == (1, "one")
    assert rows(parsed, "num_formats", "num_fmt_id", "code", order=["doc_id"]) == [(165, "yyyy")] and rows(parsed, "sheet_links", "ref", "rid", order=["ord"]) == [("A1", "rId1")]


def test_slide_page_and_other_tables(parsed):
    assert rows(parsed, "slide_paras", "heading", "bullet", "bullet_level", order=["para_ix"]) == [(1, None, 0), (0, "bullet", 1)]
    assert rows(parsed, "slide_runs", "text", order=["para_ix"]) == [("Big",), ("b",)] and rows(parsed, "slides", "slide_no", order=["slide_no"]) == [(1,)]
    assert rows(parsed, "pdf_pages", "page_no", "text", order=["page_no"]) == [(1, "x\n"), (2, "y\n")]
    assert rows(parsed, "parse_errors", "doc_id", "message", order=["doc_id"]) == [(6, "unsupported format")]
    assert [r[0] for r in rows(parsed, "doc_format", "format", order=["doc_id"])] == ["docx", "xlsx", "pptx", "xls", "doc", "pdf", None]
    assert rows(parsed, "rendered_plain", "text", order=["doc_id"])[5] == ("x\n\ny\n",)
    assert rows(parsed, "rendered_markdown", "text", order=["doc_id"])[0][0].startswith("## T\n\n  - [**l**](http://x)\n| a | b |")


def test_views(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(w.pdf([["Hello"]]))
    tables.register_views(spark, str(tmp_path), prefix="t_")
    assert spark.sql("SELECT f.format, p.text FROM t_pdf_pages p JOIN t_doc_format f USING (doc_id)").first()["text"] == "Hello\n"
