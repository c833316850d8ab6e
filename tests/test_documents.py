"""Whole files: written by the writers, read by the engine."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import render
from quillspark.plans import extract
from quillspark.sources import biff, cfb, ooxml, pdf, readers
from quillspark.sources import writers as w
from quillspark.streaming import ingest

P, R = w.docx_paragraph, w.docx_run


@pytest.fixture(scope="module")
def text_of(spark):
    def run(data, mode="plain", images=False):
        files = spark.createDataFrame([(i, f"f{i}", bytearray(b)) for i, b in enumerate(data)], "doc_id long, path string, content binary")
        return extract.extract_from(files, mode, images).orderBy("doc_id").collect()

    return run


def test_docx(text_of):
    body = (
        P(R("Title"), "Heading1") + P(R("bold ", True) + R("both", True, True) + '<w:hyperlink r:id="rId1">' + R("link ") + R("two", False, True) + "</w:hyperlink>") + P(R("item"), None, 1)
        + w.docx_table([["a", "b|c"], ["d"]]) + '<w:p><w:r><w:drawing><a:blip r:embed="rId3"/></w:drawing></w:r><w:r><w:drawing><a:blip r:embed="rId2"/></w:drawing></w:r></w:p>'
    )
    data = w.docx(body, [("rId1", "hyperlink", "http://x.y/z"), ("rId2", "image", "media/i.png"), ("rId3", "image", "media/i.emf")], {"media/i.png": w.PNG, "media/i.emf": b"\x01\0\0\0"})
    plain, md = text_of([data])[0], text_of([data], "markdown", True)[0]
    assert plain["format"] == "docx" and plain["text"] == "Title\n\nbold bothlink two\n\nitem\n\na\tb|c\n\nd\n"
    start = "# Title\n\n**bold *****both***[link *two*](http://x.y/z)\n\n  - item\n| a | b\\|c |\n| --- | --- |\n| d |  |\n\n![][image2]\n\n[image2]: <data:image/png;base64,"
    assert md["text"].startswith(start)


def test_xlsx(text_of):
    sheets = [("S1", [["h1", "h2"], [("s", 0), (45292.5, 1)], [None, 3.25]], {"links": [("A2", "http://l"), ("A2", "http://m")], "picture": w.PNG}), ("Hid", [["x"]], {"state": "hidden"}), ("Very", [["v"]], {"state": "veryHidden"}), ("E", [[""]])]
    data = w.xlsx(sheets, ["shared"], {164: "yyyy-mm-dd"}, [0, 164])
    assert text_of([data])[0]["text"] == "--- S1 ---\nh1\th2\n[[shared](http://l)](http://m)\t2024-01-01 12:00:00\n\t3.25\n\n--- Very ---\nv\n"
    md = text_of([data], "markdown", True)[0]["text"]
    assert md.startswith("## S1\n\n| h1 | h2 |\n| --- | --- |\n| [[shared](http://l)](http://m) | 2024-01-01 12:00:00 |\n|  | 3.25 |\n\n## Very\n\n| v |\n| --- |\n\n![][image1]\n\n[image1]: <data:image/png")


def test_pptx(text_of):
    one = [w.pptx_paragraph("Big", 2800), w.pptx_paragraph("one", None, "buChar") + w.pptx_paragraph("sub", None, "buAutoNum", 1) + w.pptx_paragraph("text", bold=True)]
    data = w.pptx([one, [w.pptx_paragraph("x")], [w.pptx_paragraph("z", rid="rId1")]], {3: [("rId1", "hyperlink", "http://p")]}, missing=(2,))
    assert text_of([data])[0]["text"] == "--- Slide 1 ---\nBig\n- one\n  1. sub\ntext\n\n--- Slide 3 ---\nz\n"
    assert text_of([data], "markdown")[0]["text"] == "## Slide 1\n\n### Big\n\n\n- one\n  1. sub\n\n**text**\n\n## Slide 3\n\n[z](http://p)\n\n"
    single = w.pptx([[w.pptx_paragraph("Only", 2400) + w.pptx_paragraph("a", None, "buFont") + w.pptx_paragraph("b", None, "buNone")]])
    assert text_of([single], "markdown")[0]["text"] == "## Only\n\n- a\n\nb\n\n"


def test_slide_pictures(text_of):
    pics = '<p:pic><a:blip r:embed="rId1"/></p:pic><p:pic><a:blip r:embed="rId2"/></p:pic>'
    data = w.pptx([[w.pptx_paragraph("a")], []], {1: [("rId1", "image", "../media/a.emf"), ("rId2", "image", "../media/b.png")], 2: [("rId2", "image", "../media/b.png")]}, extra={1: pics, 2: pics}, media={"media/a.emf": b"\1\0\0\0", "media/b.png": w.PNG})
    md = text_of([data], "markdown", True)[0]["text"]
    assert md.startswith("## Slide 1\n\na\n\n![][image2]\n\n## Slide 2\n\n![][image3]\n\n[image2]: <data:") and md.count("[image3]: <") == 1
    assert text_of([data], "markdown")[0]["text"] == "## Slide 1\n\na\n\n"


def test_xls(text_of):
    data = w.xls([("A", [["a", 1.5, True], [None, (45292, 1)], ["é😀", 0.1 + 0.2], [], ["last", (7.25, 2)]]), ("H", [["no"]], 1)], [0, 14, 165], {165: '"d"yyyy'})
    assert text_of([data])[0]["text"] == "a\t1.5\tTRUE\n\t2024-01-01\né😀\t0.3\nlast\t1900-01-07 06:00:00\n"
    assert text_of([data], "markdown")[0]["text"].endswith("|  |  |  |\n| last | 1900-01-07 06:00:00 |  |\n\n")


def test_doc_and_pdf(text_of):
    data = w.doc('Short Title\rA \x13HYPERLINK "http://x"\x14li\x13PAGE\x147\x15nk\x15 and\x1etext.\ra\x07b\x07c\x07d\x07e\x07f\r1.2 Intro\r\x02\r')
    assert text_of([data])[0]["text"] == "Short Title\n\nA 7[link](http://x) and-text.\n\na\tb\tc\td\te\tf\n\n1.2 Intro\n"
    assert text_of([data], "markdown")[0]["text"].startswith("**Short Title**\n\nA 7[link](http://x) and-text.\n\n| a | b | c | d | e | f |")
    pages = w.pdf([["Hello (x) \\"], [], ["World  ", "b"]])
    assert text_of([pages])[0]["text"] == "Hello (x) \\\n\nWorld\nb\n"
    assert text_of([pages], "markdown")[0]["text"] == "## Page 1\n\nHello (x) \\\n\n## Page 3\n\nWorld\nb\n"
    assert text_of([w.pdf([["x"], []], compress=False)], "markdown")[0]["text"] == "x\n"


def test_broken_files_are_rows(text_of):
    good = w.docx(P(R("ok")))
    bad = [b"", b"PK\x03\x04zz", cfb.write({"Other": b"x"}), w.doc("x", 0x1100), w.xls([("A", [["a"]])], encrypted=True), w.pdf([[]]), good[:200], cfb.MAGIC + b"\0" * 10, w.zip_of({"word/other.xml": "<x/>"})]
    rows = text_of([good, *bad])
    assert rows[0]["text"] == "ok\n" and rows[0]["error"] is None
    assert all(r["error"] and r["text"] is None for r in rows[1:])


def test_broken_xml_keeps_what_was_read():
    data = w.zip_of({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r><w:x></w:bad>'})
    record = ooxml.read_docx(data)
    assert record["broken"] and [r["text"] for b in record["blocks"] for r in b["runs"]] == ["one", "two"]


def test_biff_strings():
    assert biff.read_string(b"\x03\0\0abc", 0, 1252) == ("abc", 6)
    assert biff.read_string(b"\x02\0\x01H\0i\0", 0, 1252) == ("Hi", 7)
    assert biff.read_string(b"\x02\0\x08\x01\0Hi\0\0\0\0", 0, 1252) == ("Hi", 11)
    sst = struct.pack("<II", 1, 1) + b"\x05\0\0Hel" + b"\0lo"
    assert biff.shared_strings(sst, (14,), 1252) == ["Hello"]
    switch = struct.pack("<II", 1, 1) + b"\x03\0\0A" + b"\x01B\0C\0"
    assert biff.shared_strings(switch, (12,), 1252) == ["ABC"]
    assert biff.sheet_entry(struct.pack("<IBBBB", 0x1000, 0, 0, 5, 0) + b"Sheet", 1252) == {"name": "Sheet", "offset": 0x1000, "visibility": 0, "sheet_type": 0}
    assert biff.sheet_entry(b"\0" * 5, 1252) is None


def test_biff_formula_and_runs_of_numbers():
    rec = w.record
    stream = rec(biff.BOF, b"\0" * 16) + rec(biff.FORMULA, struct.pack("<HHH", 0, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 6) + rec(biff.STRING, b"\x02\0\0ok")
    stream += rec(biff.MULRK, struct.pack("<HHHIHIH", 1, 2, 0, (5 << 2) | 2, 0, (7 << 2) | 2, 3)) + rec(biff.BOOLERR, struct.pack("<HHHBB", 2, 0, 0, 7, 1)) + rec(biff.EOF)
    got = [(c["row"], c["col"], c["text"], c["num"]) for c in biff.sheet_cells(stream, 0, 1252)]
    assert got == [(0, 0, "ok", None), (1, 2, None, 5.0), (1, 3, None, 7.0)]


def test_wide_grid_is_empty():
    assert biff.grid_rows([{"row": 65535, "col": 255, "kind": "text"}]) == [] and len(biff.grid_rows([{"row": 3, "col": 1}])) == 4


def test_word_stream():
    assert biff.word_paragraphs("a😀﻿\x1f\x1eb\rc\x0cd") == ["a😀-b", "c", "d"]
    assert biff.word_paragraphs("x\ud83dy") == ["x�y"] and biff.word_paragraphs("\x13PAGE\x15z") == ["z"]
    block = "word text ".encode("utf-16-le").ljust(256, b"\0")
    assert biff.block_is_wide(block) and not biff.block_is_wide(b"plain text") and biff.word_units(b"\xc0", False, 1251) == "А"


def test_pdf_maps_and_arrays():
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0002> <0041> endbfrange 1 beginbfchar <0003> <00e9> endbfchar"
    body = b"BT /F1 9 Tf 0 0 Td [<00010002> -300 <0003>] TJ ET"
    objs = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Resources<</Font<</F1 4 0 R>>>>>>", b"<</Type/Page/Contents[6 0 R]>>", b"<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>", b"<</Length %d>>\nstream\n%s\nendstream" % (len(cmap), cmap), b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body)]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objs))
    assert pdf.read_pdf(data)["pages"] == ["AB é\n"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(st.characters(min_codepoint=32, max_codepoint=0x2FFF, exclude_categories=("Cs", "Cc")), min_size=1, max_size=8)), min_size=1, max_size=5), min_size=1, max_size=6))
def test_grids_round_trip(spark, rows):
    width = max(max((j for j, v in enumerate(r) if v is not None), default=-1) for r in rows) + 1
    last = max((i for i, r in enumerate(rows) if any(v is not None for v in r)), default=-1)
    want = [[(r[j] if j < len(r) else None) or "" for j in range(width)] for r in rows[: last + 1]]
    files = spark.createDataFrame([(1, bytearray(w.xls([("S", rows)])))], "doc_id long, content binary")
    record = readers.parse(files, "xls").select(render.xls_sheets(F.col("record")).alias("s")).first()["s"]
    assert record[0]["rows"] == want
    files = spark.createDataFrame([(1, bytearray(w.xlsx([("S", rows)])))], "doc_id long, content binary")
    record = readers.parse(files, "xlsx").select(render.xlsx_sheets(F.col("record")).alias("s")).first()["s"]
    assert [r for r in record[0]["rows"]] == [[(r[j] if j < len(r) else None) or "" for j in range(width)] for r in rows if any(v is not None for v in r)]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(w.docx(P(R("first"))))
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(w.pdf([["second"]]))
    rows = extract.extract(spark, str(tmp_path / "in"))
    assert sorted((r["format"], r["text"]) for r in rows.collect()) == [("docx", "first\n"), ("pdf", "second\n")]
    assert "".join(r["text"] for r in extract.joined(rows).collect()) == "first\n\nsecond\n"
    stream = ingest.extract_stream(spark, str(tmp_path / "in"))
    assert stream.isStreaming
    assert sorted(r["text"] for r in ingest.run_to_end(stream, "test").collect()) == ["first\n", "second\n"]
