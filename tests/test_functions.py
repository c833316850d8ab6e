"""Column functions on the value pairs that define them."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import binary, markup, numbers, refs, text
from quillspark.operators import render
from quillspark.sources import biff, readers


def test_trim_is_unicode(values):
    assert values(text.trim_u, [" \t a  \n", "", "　", "a b"], "string") == ["a", "", "", "a b"]
    assert values(text.rtrim_u, [" a \u0085", "\n"], "string") == [" a", ""]


def test_lines(values):
    assert values(text.lines, ["", "a", "a\n", "a\r\nb\n\n", "a\rb", "\n"], "string") == [[], ["a"], ["a"], ["a", "b", ""], ["a\rb"], [""]]


def test_plain_paragraphs(values):
    assert values(text.plain_paragraphs, [["a ", " ", "b"], [], [" "]], "array<string>") == ["a\n\nb\n", "", ""]


def test_clean_page(values):
    pages = ["a  \nb\t", "a\n\n\n\n\n\nb", "\n\n x\n\n", "", " \n \n", "a\n\n\nb"]
    assert values(text.clean_page, pages, "string") == ["a\nb\n", "a\n\n\nb\n", " x\n", "", "", "a\n\n\nb\n"]


def test_section_numbers(values):
    cases = {"1. Foo": "Foo", "2.3 Bar": "Bar", "10.1.2 X": "X", "1.5x speed": "x speed", "42 plain": None, "no": None, "1.": "", ".1 x": None}
    assert values(text.section_number_rest, list(cases), "string") == list(cases.values())


def test_numbered_headings(values):
    cases = {
        "1. Introduction": "# 1. Introduction", "2.3 Details": "# 2.3 Details", "2.3.1 More": "## 2.3.1 More", "1.2.3.4.5 Deep": "### 1.2.3.4.5 Deep", "1. A sentence.": None,
        "Appendix 1: Servers": "## Appendix 1: Servers", "scenario 2: x": "## scenario 2: x", "Appendix 1": None, "Plain": None, "1. " + "x" * 130: None, "10.5%": "# 10.5%",
    }
    assert values(text.numbered_heading, list(cases), "string") == list(cases.values())


def test_subheading_shape(values):
    cases = {"Short Title": True, "One": False, "ends here.": False, "lower case": False, "A, b;": False, "Ünder Way": True, "Xy": False, "A " + "x" * 79: False}
    assert values(text.subheading_shape, list(cases), "string") == list(cases.values())


def test_column_count(values):
    cells = [["a"], ["a", "b"], list("abc"), list("abcdef"), ["a", "b", "", "c", "d", "", "e", "f", ""], list("abcdefghi"), list("abcdefgh"), list("abcdefghijk")]
    assert values(text.column_count, cells, "array<string>") == [1, 1, 3, 6, 3, 3, 4, 6]


def test_text_markdown(values):
    cases = {
        "": "", "a\tb": "a b\n\n", "a\tb\nc\td": "a b\n\nc d\n\n", "a\tb\tc\td\te\tf": "| a | b | c | d | e | f |\n| --- | --- | --- | --- | --- | --- |\n\n",
        "Intro Part\n\nText goes on.": "**Intro Part**\n\nText goes on.\n\n", "Intro Part\nText": "Intro Part\n\nText\n\n", "a\tb|\tc\nd\te\tf": "| a | b\\| | c |\n| --- | --- | --- |\n\n| d | e | f |\n| --- | --- | --- |\n\n",
    }
    assert values(render.text_markdown, list(cases), "string") == list(cases.values())


def test_serials(values):
    cases = {
        1.0: "1900-01-01", 59.0: "1900-02-28", 60.0: "1900-02-29", 61.0: "1900-03-01", 36525.0: "1999-12-31", 36526.0: "2000-01-01", 45292.0: "2024-01-01", 45292.5: "2024-01-01 12:00:00",
        45292.25: "2024-01-01 06:00:00", 0.5: "12:00:00", 0.25: "06:00:00", -1.0: "-1", 0.0: "0", 3e6: "3000000", 2958465.0: "9999-12-31", 1e20: "100000000000000000000", 44000.9999999: "2020-06-18 00:00:00",
    }
    assert values(numbers.serial_to_iso, list(cases), "double") == list(cases.values())
    assert values(numbers.hms, [0.0, 0.5, 0.999988425925926], "double") == ["00:00:00", "12:00:00", "23:59:59"]


def test_date_formats(values):
    assert values(numbers.is_date_format_id, [14, 22, 27, 45, 0, 1, 164], "int") == [True] * 4 + [False] * 3
    cases = {"yyyy-mm-dd": True, "m/d/yy": True, "hh:mm:ss": True, '"年"yyyy': True, "#,##0.00": False, "General": False, "0%": False, "yyyy-mm-dd #0": False, '"day"': False, "\\d": False, "[Red]General": True}
    assert values(numbers.is_date_format_code, list(cases), "string") == list(cases.values())


def test_numbers(values):
    cases = {42.0: "42", 0.0: "0", -7.0: "-7", 3.125: "3.125", 1.5: "1.5", -0.0: "0", 1e-12: "0", 2.0**53: "9007199254740992", 0.1: "0.1", 1e20: "100000000000000000000"}
    assert values(numbers.format_number, list(cases), "double") == list(cases.values())
    assert [numbers.exact_number(x) for x in cases] == list(cases.values())
    assert values(numbers.shortest_number, [1e16, 1.5e-7, 0.1, -2.5e17], "double") == ["10000000000000000", "0.00000015", "0.1", "-250000000000000000"]


def test_rk(values):
    cases = {(1 << 2) | 2: 1.0, (42 << 2) | 2: 42.0, 2: 0.0, 0xFFFFFFFE: -1.0, (150 << 2) | 3: 1.5, 0x3FF00000: 1.0, 0x40590000 | 1: 1.0, 0: 0.0, 0xC0590000: -100.0}
    assert values(numbers.rk_value, list(cases), "bigint") == list(cases.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=20, max_size=60))
def test_rk_native_is_the_bit_pattern(values, rks):
    got = values(numbers.rk_value, rks, "bigint")
    for rk, x in zip(rks, got):
        want = numbers.rk_number(rk)
        assert x == want or (x != x and want != want) or struct.pack("<d", x) == struct.pack("<d", want)


def test_references(values):
    cols = {"A1": 0, "B5": 1, "Z1": 25, "AA1": 26, "AZ1": 51, "BA1": 52, "c3": 2, "7": 0, "": 0}
    assert values(refs.col_index, list(cols), "string") == list(cols.values())
    rows = {"A1": 0, "B3": 2, "AA100": 99, "A1:B2": 0, "$A$1": 0, "A": 0, "A0": 0}
    assert values(refs.row_index, list(rows), "string") == list(rows.values())


def test_paths(values):
    cases = {"ppt/slides/../media/image1.png": "ppt/media/image1.png", "a/b/c/../../d/image.png": "a/d/image.png", "../x": "x", "./a//b": "a/b", "": ""}
    assert values(refs.normalize_path, list(cases), "string") == list(cases.values())
    assert values(refs.rels_path, ["ppt/slides/slide1.xml", "a.xml"], "string") == ["ppt/slides/_rels/slide1.xml.rels", "_rels/a.xml.rels"]
    assert values(lambda c: refs.part_path(c, "xl"), ["/xl/a.xml", "worksheets/s.xml"], "string") == ["xl/a.xml", "xl/worksheets/s.xml"]


def test_images(values):
    cases = [(b"\xff\xd8\xff\xe0", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF89a", "image/gif"), (b"RIFF\0\0\0\0WEBP", "image/webp"), (b"BM\0\0", "image/bmp"), (b"<?xml?><svg/>", "image/svg+xml"), (b"\x01\0\0\0", None), (b"BM", None), (b"<html>", None)]
    assert values(binary.image_mime, [bytearray(b) for b, _ in cases], "binary") == [m for _, m in cases]
    long = bytearray(b"\x89PNG" + bytes(300))
    got = values(lambda c: binary.image_definition(F.lit("image1"), F.lit("image/png"), c), [long], "binary")[0]
    assert got.startswith("[image1]: <data:image/png;base64,iVBOR") and "\n" not in got and "\r" not in got


def test_code_pages(values):
    assert binary.decode_bytes(b"ABC\x80", 1252) == "ABC€" and binary.decode_bytes(b"\xc0", 1251) == "А" and binary.decode_bytes(b"\x81", 1252) == "\x81"
    assert values(binary.language_page, [0x0419, 0x0411, 0x0804, 0x0409, 0x0415, 0x0402, 0x0404], "int") == [1251, 932, 936, 1252, 1250, 1252, 936]
    assert values(lambda c: binary.decode_page(c, 1251), [bytearray(b"a\xc0"), bytearray(b"")], "binary") == ["aА", ""]


def test_containers(values):
    assert values(binary.container, [bytearray.fromhex(h) for h in (binary.OLE2, binary.PDF, binary.ZIP, "00", "")], "binary") == ["ole2", "pdf", "zip", None, None]


def test_runs(values):
    kind = "array<struct<text string, bold boolean, italic boolean, link_url string>>"
    cases = [
        ([("a", True, False, None), ("b", False, True, None), ("c", True, True, None), (" ", True, True, None)], "**a***b****c*** "),
        ([("x ", False, False, "u"), ("y", True, False, "u"), ("z", False, False, "v"), ("w", False, False, None)], "[x **y**](u)[z](v)w"),
        ([(" ", False, False, "u")], ""), ([], ""), ([("a", False, False, "u"), ("b", False, False, None), ("c", False, False, "u")], "[a](u)b[c](u)"),
    ]
    assert values(markup.runs_markdown, [c for c, _ in cases], kind) == [m for _, m in cases]


def test_heading_styles(values):
    cases = {"Heading1": 1, "Heading9": 9, "heading2": 2, "heading 4": 4, "Title": 1, "Subtitle": 2, "Normal": None, "ListParagraph": None, "HeadingX": None, "Heading": None, "Heading 1": None}
    assert values(markup.heading_level, list(cases), "string") == list(cases.values())
    assert values(markup.font_heading, [2800, 2400, 2000, 1999, None], "int") == [1, 2, 3, 0, 0]


@pytest.mark.parametrize("code,url", [(' HYPERLINK "http://x" \\l "b"', "http://x"), ("hyperlink http://y \\h", "http://y"), ("PAGE", None), ('HYPERLINK \\l "b"', None), ("HyperLink  \"\"", None)])
def test_field_urls(values, code, url):
    from quillspark.sources.biff import field_url

    assert values(markup.hyperlink_url, [code], "string") == [url] and field_url(code) == url


def test_only_the_first_keyword_counts(values):
    fields = ['HYPERLINK \\l "hyperlinkfoo"', 'x hyperlink "http://a" HYPERLINK "http://b"', "HYPERLINK", 'HyperLink\n"u', "hyperlink http://c\\l", "PAGE", 'HYPERLINK ""']
    want = [None, "http://a", None, "u", "http://c", None, None]
    assert values(markup.hyperlink_url, fields, "string") == want
    assert [biff.field_url(f) for f in fields] == want


def test_numbers_are_rounded_by_their_binary_value(values):
    rng = random.Random(5)
    ties = [(rng.randrange(10 ** rng.randint(1, 16)) * 10 + 5) / 1e11 for _ in range(3000)]
    exact = [k / 2**11 for k in range(1, 4000, 2)]  # eleven binary places: true ties
    some = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 15) for _ in range(2000)]
    numbers_ = [x for t in ties + exact for x in (t, -t)] + some + [0.00000000005, -0.00000000005, 0.00000000015, 2.5e-11, 0.1 + 0.2]
    got = values(numbers.format_number, numbers_, "double")
    assert [(x, g) for x, g in zip(numbers_, got) if g != numbers.exact_number(x)] == []


def test_size_guard_needs_no_bytes(spark):
    files = spark.createDataFrame([(1, "a", 300 << 20, None), (2, "b", 8, bytearray(b"%PDF-1.4"))], "doc_id long, path string, length long, content binary")
    got = {r["doc_id"]: r["error"] for r in readers.detect(files).collect()}
    assert got[1] == "file too large: 300.0 MiB" and got[2] is None
