"""Raw facts of OOXML documents: relationship ids, style ids and cell values as they stand.

Each reader returns one nested record a document (see schemas.py).  Every lookup, default, numbering
and rendering step is left to DataFrame expressions."""

from __future__ import annotations

from .xmltree import Node, Parts, is_image, parse, relationships, resolve


def _off(n: Node) -> bool:
    return n.get("w:val", "val") in ("false", "0")


# ── Word ──


def _run(r: Node, rid: str | None) -> tuple[dict | None, str | None]:
    text, bold, italic, image = [], False, False, None
    for n in r.elements():
        if n.name == "rPr":
            for p in n.all("b", "bCs", "i", "iCs"):
                if p.name in ("b", "bCs"):
                    bold = not _off(p)
                else:
                    italic = not _off(p)
    for n in r.outermost("t", "tab", "br", "drawing", "rPr", "r"):
        if n.name == "t":
            text.append(n.text())
        elif n.name in ("tab", "br") and not n.kids:
            text.append("\t" if n.name == "tab" else "\n")
        elif n.name == "drawing":
            image = next((b.get("r:embed") for b in reversed(list(n.all("blip"))) if b.get("r:embed")), image)
    run = {"text": "".join(text), "bold": bold, "italic": italic, "link_rid": rid}
    return (run if run["text"] else None), image


def _paragraph(p: Node) -> tuple[dict, list[str]]:
    out = {"kind": "paragraph", "p_style": None, "ilvl": None, "runs": [], "rows": None, "image_rid": None}
    images: list[str] = []

    def walk(node: Node, rid: str | None):
        for n in node.elements():
            if n.name == "pPr":
                for x in n.all("pStyle", "ilvl"):
                    out["p_style" if x.name == "pStyle" else "ilvl"] = x.get("w:val", "val")
            elif n.name == "r":
                run, image = _run(n, rid)
                out["runs"] += [run] if run else []
                images.extend([image] if image else [])
            elif n.name == "hyperlink":
                walk(n, n.get("r:id"))
            elif n.name in ("tab", "br") and not n.kids:
                out["runs"].append({"text": "\t" if n.name == "tab" else "\n", "bold": False, "italic": False, "link_rid": None})
            else:
                walk(n, rid)

    walk(p, None)
    return out, images


def _table(t: Node) -> dict:
    rows = [[[_paragraph(p)[0]["runs"] for p in c.outermost("p", "tbl") if p.name == "p"] for c in r.outermost("tc")] for r in t.outermost("tr")]
    return {"kind": "table", "p_style": None, "ilvl": None, "runs": None, "rows": rows, "image_rid": None}


def read_docx(data: bytes, images: bool = False) -> dict:
    parts = Parts(data)
    tree = parse(parts.must("word/document.xml"))
    blocks: list[dict] = []
    for body in tree.outermost("body"):
        for n in body.outermost("p", "tbl"):
            if n.name == "tbl":
                blocks.append(_table(n))
            else:
                block, found = _paragraph(n)
                blocks.append(block)
                blocks += [{"kind": "image", "p_style": None, "ilvl": None, "runs": None, "rows": None, "image_rid": rid} for rid in found]
    rels = relationships(parts, "word/document.xml")
    media = {}
    if images:
        for r in rels:
            if is_image(r):
                name = r["target"].lstrip("/") if r["target"].startswith("/") else "word/" + r["target"]
                found = parts.read(resolve(name, ""))
                if found is not None:
                    media[r["rid"]] = found
    return {"blocks": blocks, "rels": rels, "media": list(media.items()), "broken": tree.broken}


# ── Excel ──


def _cell(c: Node, at: int) -> dict:
    kind = c.get("t") or ""
    value = inline = None
    for n in c.outermost("v", "is"):
        if n.name == "v":
            value = n.text()
        else:
            inline = n.text()
    ref = c.get("r")
    return {"ref": ref, "at": at, "col": column(ref) if ref is not None else at, "type": kind, "style": c.get("s"), "raw": inline if kind == "inlineStr" else value}


def column(ref: str) -> int:
    """0-based column of a cell reference; 0 without letters."""
    n = 0
    for ch in ref:
        if not ("a" <= ch.lower() <= "z"):
            break
        n = n * 26 + ord(ch.upper()) - 64
    return max(0, n - 1)


def _row(r: Node) -> list[dict]:
    """Cells of a row, the last one of each column."""
    cells = [_cell(c, i) for i, c in enumerate(r.outermost("c"))]
    return list({c["col"]: c for c in cells}.values())


def read_xlsx(data: bytes, images: bool = False) -> dict:
    parts = Parts(data)
    strings = parts.tree("xl/sharedStrings.xml")
    styles = parts.tree("xl/styles.xml")
    book = parse(parts.must("xl/workbook.xml"))
    parts.must("xl/_rels/workbook.xml.rels")
    rels = relationships(parts, "xl/workbook.xml")
    sheets = [{"name": s.get("name") or "", "rid": s.get("r:id") or "", "state": s.get("state") or ""} for s in book.all("sheet")]
    wanted = {}
    for s in sheets:
        r = next((r for r in rels if r["rid"] == s["rid"]), None)
        if r:
            wanted.setdefault(r["target"].lstrip("/") if r["target"].startswith("/") else "xl/" + r["target"], None)
    found = []
    for path in wanted:
        tree = parts.tree(path)
        if tree is None:
            continue
        rows = [_row(r) for r in tree.all("row") if any(r.elements())]
        numbers = [r.get("r") for r in tree.all("row") if any(r.elements())]
        links = [{"ref": h.get("ref") or "", "rid": h.get("r:id") or ""} for hs in tree.outermost("hyperlinks") for h in hs.all("hyperlink")]
        pictures = _sheet_pictures(parts, path) if images else []
        found.append({"path": path, "rows": [{"r": n, "cells": r} for n, r in zip(numbers, rows)], "links": links, "rels": relationships(parts, path), "pictures": pictures})
    return {
        "shared": [n.text() for n in strings.all("si")] if strings else [],
        "num_formats": [{"id": _int(n.get("numFmtId")), "code": n.get("formatCode") or ""} for n in styles.all("numFmt") if _int(n.get("numFmtId")) is not None] if styles else [],
        "xfs": [_int(x.get("numFmtId")) or 0 for xs in styles.outermost("cellXfs") for x in xs.all("xf")] if styles else [],
        "sheets": sheets,
        "rels": rels,
        "parts": found,
        "broken": book.broken,
    }


def _int(s: str | None) -> int | None:
    try:
        return int(s) if s is not None else None
    except ValueError:
        return None


def _sheet_pictures(parts: Parts, path: str) -> list[bytes]:
    """Bytes of a sheet's pictures: sheet -> drawing -> image, misses skipped at each step."""
    out = []
    for r in relationships(parts, path):
        if r["type"].endswith("/drawing") and r["target"]:
            drawing = resolve(r["target"], path.rpartition("/")[0] or "xl")
            tree = parts.tree(drawing)
            targets = {x["rid"]: x["target"] for x in relationships(parts, drawing) if is_image(x)}
            for b in tree.all("blip") if tree else ():
                target = targets.get(b.get("r:embed") or "")
                data = parts.read(resolve(target, drawing.rpartition("/")[0] or "xl")) if target else None
                if data is not None:
                    out.append(data)
    return out


# ── PowerPoint ──


def _slide_run(r: Node, field: bool) -> dict:
    out = {"text": "", "bold": False, "italic": False, "link_rid": None, "font_size": None, "is_field": field}
    for n in r.outermost("rPr", "t"):
        if n.name == "t":
            out["text"] += n.text()
        else:
            out["bold"], out["italic"] = n.get("b") == "1" if n.get("b") else out["bold"], n.get("i") == "1" if n.get("i") else out["italic"]
            out["font_size"] = _int(n.get("sz")) if n.get("sz") else out["font_size"]
            for h in n.all("hlinkClick"):
                out["link_rid"] = h.get("r:id") or out["link_rid"]
    return out


def _slide_paragraph(p: Node) -> dict:
    runs, marks, level = [], [], 0
    for n in p.outermost("pPr", "r", "fld", "br"):
        if n.name == "pPr" and any(n.elements()):
            level = _int(n.get("lvl")) or 0
            level = level if 0 <= level <= 255 else 0
            marks = [x.name for x in n.all("buChar", "buBlip", "buFont", "buAutoNum", "buNone")]
        elif n.name in ("r", "fld"):
            runs.append(_slide_run(n, n.name == "fld"))
        elif n.name == "br" and not n.kids:
            runs.append({"text": "\n", "bold": False, "italic": False, "link_rid": None, "font_size": None, "is_field": True})
    return {"runs": runs, "marks": marks, "level": level}


def read_pptx(data: bytes, images: bool = False) -> dict:
    parts = Parts(data)
    show = parse(parts.must("ppt/presentation.xml"))
    parts.must("ppt/_rels/presentation.xml.rels")
    rels = relationships(parts, "ppt/presentation.xml")
    order = [n.get("r:id") or "" for n in show.all("sldId")]
    targets = {r["rid"]: r["target"] for r in rels if r["rid"] and r["target"]}
    slides = []
    for number, rid in enumerate(order, 1):
        target = targets.get(rid)
        if target is None:
            continue
        path = target.lstrip("/") if target.startswith("/") else "ppt/" + target
        tree = parts.tree(path)
        if tree is None:
            continue
        shapes = [[_slide_paragraph(p) for body in s.outermost("txBody") for p in body.outermost("p")] for s in tree.outermost("sp", "graphicFrame")]
        mine = relationships(parts, path)
        pictures = []
        if images:
            targets_here = {r["rid"]: r["target"] for r in mine if is_image(r)}
            for b in (b for pic in tree.outermost("pic") for b in pic.all("blip")):
                t = targets_here.get(b.get("r:embed") or "")
                found = parts.read(resolve(t, path.rpartition("/")[0] or "ppt")) if t else None
                if found is not None:
                    pictures.append(found)
        slides.append({"number": number, "path": path, "shapes": shapes, "rels": mine, "pictures": pictures})
    return {"slides": slides, "rels": rels, "broken": show.broken}
