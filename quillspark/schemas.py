"""Schemas of parsed documents (one nested record each) and of the tables unnested from them."""

REL = "struct<rid string, target string, type string, mode string>"
RUN = "struct<text string, bold boolean, italic boolean, link_rid string>"
MEDIA = "array<struct<rid string, data binary>>"

DOCX = f"struct<blocks array<struct<kind string, p_style string, ilvl string, runs array<{RUN}>, rows array<array<array<array<{RUN}>>>>, image_rid string>>, rels array<{REL}>, media {MEDIA}, broken boolean>"
CELL = "struct<ref string, at int, col int, type string, style string, raw string>"
XLSX = (
    "struct<shared array<string>, num_formats array<struct<id int, code string>>, xfs array<int>, sheets array<struct<name string, rid string, state string>>, "
    f"rels array<{REL}>, parts array<struct<path string, rows array<struct<r string, cells array<{CELL}>>>, links array<struct<ref string, rid string>>, rels array<{REL}>, pictures array<binary>>>, broken boolean>"
)
SLIDE_RUN = "struct<text string, bold boolean, italic boolean, link_rid string, font_size int, is_field boolean>"
PPTX = f"struct<slides array<struct<number int, path string, shapes array<array<struct<runs array<{SLIDE_RUN}>, marks array<string>, level int>>>, rels array<{REL}>, pictures array<binary>>>, rels array<{REL}>, broken boolean>"
XLS = "struct<sst array<string>, formats array<struct<id int, code string>>, xfs array<int>, sheets array<struct<name string, offset bigint, visibility int, sheet_type int, rows array<array<struct<col int, kind string, text string, num double, sst bigint, xf int>>>>>>"
DOC = "struct<paragraphs array<string>>"
PDF = "struct<pages array<string>>"

RECORDS = {"docx": DOCX, "xlsx": XLSX, "pptx": PPTX, "xls": XLS, "doc": DOC, "pdf": PDF}
