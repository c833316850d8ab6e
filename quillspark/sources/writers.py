"""Minimal writers of all six formats, for fixtures and round trips.  Standard library only."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

from . import cfb

_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
PNG = bytes.fromhex("89504E470D0A1A0A") + b"\0" * 8


def zip_of(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {"[Content_Types].xml": _TYPES, **parts}.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def rels_xml(rels: list[tuple[str, str, str]]) -> str:
    """From (id, kind such as "hyperlink", target); http targets are external."""
    rows = "".join(f'<Relationship Id="{i}" Type="{_REL}/{k}" Target={quoteattr(t)}{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>' for i, k, t in rels)
    return f'<Relationships xmlns="{_PKG}">{rows}</Relationships>'


def docx_run(text: str, bold=False, italic=False) -> str:
    return f'<w:r><w:rPr>{"<w:b/>" if bold else ""}{"<w:i/>" if italic else ""}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def docx_paragraph(runs: str, style: str | None = None, level: int | None = None) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>' if level is not None else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{runs}</w:p>"


def docx_table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{docx_paragraph(docx_run(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(body: str, rels: list[tuple[str, str, str]] = (), media: dict[str, bytes] | None = None) -> bytes:
    xml = f'<w:document xmlns:w="urn:w" xmlns:r="{_REL}" xmlns:a="urn:a"><w:body>{body}</w:body></w:document>'
    return zip_of({"word/document.xml": xml, "word/_rels/document.xml.rels": rels_xml(list(rels)), **{f"word/{k}": v for k, v in (media or {}).items()}})


def letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(sheets: list[tuple], shared: list[str] = (), formats: dict[int, str] | None = None, xfs: list[int] = ()) -> bytes:
    """Sheets are (name, rows[, options]); a cell is a string (inline), a number, ("s", index), or (number, style);
    options: state, links [(ref, url)], picture."""
    parts, book, book_rels = {}, "", []
    for k, (name, rows, *more) in enumerate(sheets, 1):
        o = more[0] if more else {}
        xml = ""
        for i, row in enumerate(rows):
            cells = ""
            for j, v in enumerate(row):
                ref = f"{letters(j)}{i + 1}"
                if v is None:
                    continue
                if isinstance(v, str):
                    cells += f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
                elif isinstance(v, tuple) and v[0] == "s":
                    cells += f'<c r="{ref}" t="s"><v>{v[1]}</v></c>'
                elif isinstance(v, tuple):
                    cells += f'<c r="{ref}" s="{v[1]}"><v>{v[0]!r}</v></c>'
                else:
                    cells += f'<c r="{ref}"><v>{v!r}</v></c>'
            xml += f'<row r="{i + 1}">{cells}</row>'
        rels = [(f"rId{n}", "hyperlink", url) for n, (_, url) in enumerate(o.get("links", []), 1)]
        links = "".join(f'<hyperlink ref="{ref}" r:id="rId{n}"/>' for n, (ref, _) in enumerate(o.get("links", []), 1))
        if o.get("picture"):
            rels.append(("rIdD", "drawing", f"../drawings/drawing{k}.xml"))
            parts |= {f"xl/drawings/drawing{k}.xml": f'<d xmlns:a="urn:a" xmlns:r="{_REL}"><a:blip r:embed="rId1"/></d>', f"xl/drawings/_rels/drawing{k}.xml.rels": rels_xml([("rId1", "image", f"../media/image{k}.png")]), f"xl/media/image{k}.png": o["picture"]}
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns:r="{_REL}"><sheetData>{xml}</sheetData>{f"<hyperlinks>{links}</hyperlinks>" if links else ""}</worksheet>'
        if rels:
            parts[f"xl/worksheets/_rels/sheet{k}.xml.rels"] = rels_xml(rels)
        state = f' state="{o["state"]}"' if "state" in o else ""
        book += f'<sheet name={quoteattr(name)} sheetId="{k}"{state} r:id="rId{k}"/>'
        book_rels.append((f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml"))
    parts["xl/workbook.xml"] = f'<workbook xmlns:r="{_REL}"><sheets>{book}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = rels_xml(book_rels)
    if shared:
        parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>"
    if xfs:
        codes = "".join(f'<numFmt numFmtId="{i}" formatCode={quoteattr(c)}/>' for i, c in (formats or {}).items())
        parts["xl/styles.xml"] = f'<styleSheet><numFmts>{codes}</numFmts><cellXfs>{"".join(f"<xf numFmtId={chr(34)}{x}{chr(34)}/>" for x in xfs)}</cellXfs></styleSheet>'
    return zip_of(parts)


def pptx_paragraph(text: str, size: int | None = None, bullet: str | None = None, level: int = 0, bold=False, rid: str | None = None) -> str:
    props = f'<a:pPr lvl="{level}"><a:{bullet}/></a:pPr>' if bullet else ""
    link = f'<a:hlinkClick r:id="{rid}"/>' if rid else ""
    return f'<a:p>{props}<a:r><a:rPr{f" sz={chr(34)}{size}{chr(34)}" if size else ""}{" b=" + chr(34) + "1" + chr(34) if bold else ""}>{link}</a:rPr><a:t>{escape(text)}</a:t></a:r></a:p>'


def pptx(slides: list[list[str]], rels: dict[int, list[tuple[str, str, str]]] | None = None, missing: tuple[int, ...] = (), extra: dict[int, str] | None = None, media: dict[str, bytes] | None = None) -> bytes:
    """Slides are lists of shapes, each the XML of its paragraphs; `missing` slides have no part."""
    parts, ids, book = {}, "", []
    for k, shapes in enumerate(slides, 1):
        ids += f'<p:sldId id="{255 + k}" r:id="rId{k}"/>'
        book.append((f"rId{k}", "slide", f"slides/slide{k}.xml"))
        if k in missing:
            continue
        body = "".join(f"<p:sp><p:txBody>{s}</p:txBody></p:sp>" for s in shapes) + (extra or {}).get(k, "")
        parts[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="{_REL}">{body}</p:sld>'
        if rels and k in rels:
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = rels_xml(rels[k])
    parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="urn:p" xmlns:r="{_REL}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = rels_xml(book)
    return zip_of(parts | {f"ppt/{k}": v for k, v in (media or {}).items()})


def record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def biff_string(s: str) -> bytes:
    wide = any(ord(c) > 0x7F for c in s)
    return struct.pack("<HB", len(s.encode("utf-16-le")) // 2, wide) + (s.encode("utf-16-le") if wide else s.encode("latin-1"))


def xls(sheets: list[tuple], xfs: list[int] = (0,), formats: dict[int, str] | None = None, encrypted: bool = False) -> bytes:
    """Sheets are (name, rows[, visibility]); a cell is a string (shared), a number, a bool, or (number, style)."""
    from .biff import BOF, BOOLERR, BOUNDSHEET, CODEPAGE, CONTINUE, EOF, FILEPASS, FORMAT, LABELSST, NUMBER, SST, XF

    strings: dict[str, int] = {}
    bodies = []
    for _, rows, *_ in sheets:
        body = record(BOF, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12)
        for i, row in enumerate(rows):
            for j, v in enumerate(row):
                if v is None:
                    continue
                if isinstance(v, str):
                    body += record(LABELSST, struct.pack("<HHHI", i, j, 0, strings.setdefault(v, len(strings))))
                elif isinstance(v, bool):
                    body += record(BOOLERR, struct.pack("<HHHBB", i, j, 0, v, 0))
                else:
                    number, style = v if isinstance(v, tuple) else (v, 0)
                    body += record(NUMBER, struct.pack("<HHHd", i, j, style, number))
        bodies.append(body + record(EOF))
    head = record(BOF, struct.pack("<HH", 0x600, 5) + b"\0" * 12) + (record(FILEPASS, b"\0" * 6) if encrypted else b"") + record(CODEPAGE, struct.pack("<H", 1200))
    for i, code in (formats or {}).items():
        head += record(FORMAT, struct.pack("<H", i) + biff_string(code))
    for x in xfs:
        head += record(XF, struct.pack("<HH", 0, x) + b"\0" * 16)
    chunks = []
    whole = [struct.pack("<II", len(strings), len(strings)), *map(biff_string, strings)]
    current = b""
    for w in whole:  # a record ends between strings
        if len(current) + len(w) > 8000:
            chunks.append(current)
            current = b""
        current += w
    chunks.append(current)
    head_sst = record(SST, chunks[0]) + b"".join(record(CONTINUE, c) for c in chunks[1:])
    names = [n.encode("utf-16-le") for n, *_ in sheets]
    offset = len(head) + len(head_sst) + sum(4 + 8 + len(n) for n in names) + len(record(EOF))
    bounds = b""
    for (name, _, *more), raw, body in zip(sheets, names, bodies):
        bounds += record(BOUNDSHEET, struct.pack("<IBBBB", offset, more[0] if more else 0, 0, len(raw) // 2, 1) + raw)
        offset += len(body)
    return cfb.write({"Workbook": head + bounds + head_sst + record(EOF) + b"".join(bodies)})


def doc(text: str | bytes, flags: int = 0x1000, lid: int = 0x409) -> bytes:
    """A Word document of a character stream, written as UTF-16, or of bytes as they are."""
    raw = text if isinstance(text, bytes) else text.encode("utf-16-le", "surrogatepass")
    head = bytearray(512)
    struct.pack_into("<HHHHHH", head, 0, 0xA5EC, 0xC1, 0, lid, 0, flags)
    struct.pack_into("<II", head, 24, 512, 512 + len(raw))
    return cfb.write({"WordDocument": bytes(head) + raw})


def pdf(pages: list[list[str]], compress: bool = True) -> bytes:
    """Pages of lines, in Windows 1252."""
    objects: dict[int, bytes] = {}
    kids = []
    for k, rows in enumerate(pages):
        page, content = 4 + 2 * k, 5 + 2 * k
        body = b"BT /F1 12 Tf 72 720 Td\n" + b"".join(b"(" + r.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td\n" for r in rows) + b"ET"
        raw = zlib.compress(body) if compress else body
        objects[page] = b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % content
        objects[content] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(raw), b"/Filter/FlateDecode" if compress else b"", raw)
        kids.append(b"%d 0 R" % page)
    objects |= {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(kids), len(kids)), 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"}
    out, offsets = b"%PDF-1.4\n", {}
    for n in sorted(objects):
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % offsets[n] for n in sorted(objects))
    return out + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)
