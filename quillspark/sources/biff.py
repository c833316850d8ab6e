"""Raw facts of legacy workbooks (BIFF8 records) and of legacy Word text, and writers for fixtures."""

from __future__ import annotations

import re
import struct

from ..functions.binary import LANGUAGES, decode_bytes
from ..functions.markup import HYPERLINK_REST, HYPERLINK_URL
from ..functions.numbers import rk_number
from .cfb import CompoundFile

#: Record types.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, LABELSST = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x00FD
LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, STRING = 0x0204, 0x00D6, 0x0203, 0x027E, 0x00BD, 0x0006, 0x0207
BOOLERR, FILEPASS, FORMAT, XF, CODEPAGE = 0x0205, 0x002F, 0x041E, 0x00E0, 0x0042
MAX_RECORDS = 2_000_000


def records(data: bytes, at: int = 0):
    """(type, body) of each record; ends at a zero record, at the cap, or where less than a header is left."""
    for _ in range(MAX_RECORDS):
        if at + 4 > len(data):
            return
        kind, size = struct.unpack_from("<HH", data, at)
        if kind == 0 and size == 0:
            return
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def decode_utf16(data: bytes) -> str:
    return data[: len(data) // 2 * 2].decode("utf-16-le", "replace")


def read_string(data: bytes, at: int, page: int, cuts: tuple[int, ...] = ()) -> tuple[str, int]:
    """A counted string and where it ends.  At a cut (a CONTINUE record's start) inside the characters, a
    byte tells anew whether they are wide."""
    if at + 3 > len(data):
        return "", len(data)
    left, flags = struct.unpack_from("<HB", data, at)
    at += 3
    wide = bool(flags & 1)
    tail = 0
    if flags & 8:
        if at + 2 > len(data):
            return "", len(data)
        tail += 4 * struct.unpack_from("<H", data, at)[0]
        at += 2
    if flags & 4:
        if at + 4 > len(data):
            return "", len(data)
        tail += struct.unpack_from("<I", data, at)[0]
        at += 4
    out = []
    ahead = [c for c in cuts if c >= at]
    while left and at < len(data):
        if ahead and ahead[0] == at:
            wide = bool(data[at] & 1)
            at += 1
            ahead.pop(0)
        end = ahead[0] if ahead else len(data)
        width = 2 if wide else 1
        n = min(left, (end - at) // width)
        raw = data[at : at + n * width]
        out.append(decode_utf16(raw) if wide else decode_bytes(raw, page))
        left -= n
        at += n * width
        if left and n == 0:
            at = end if end > at else at + 1  # half a character before a cut
    return "".join(out), at + tail


def _globals(stream: bytes) -> dict:
    out = {"sst": [], "formats": [], "xfs": [], "sheets": [], "page": 1252}
    rows = list(records(stream))
    i = 0
    while i < len(rows):
        kind, body = rows[i]
        if kind == FILEPASS:
            raise ValueError("workbook is encrypted")
        if kind == CODEPAGE and len(body) >= 2:
            out["page"] = struct.unpack_from("<H", body)[0]
        elif kind == FORMAT and len(body) >= 5:
            out["formats"].append({"id": struct.unpack_from("<H", body)[0], "code": read_string(body, 2, out["page"])[0]})
        elif kind == XF and len(body) >= 4:
            out["xfs"].append(struct.unpack_from("<H", body, 2)[0])
        elif kind == SST:
            data, cuts = body, []
            while i + 1 < len(rows) and rows[i + 1][0] == CONTINUE:
                i += 1
                cuts.append(len(data))
                data += rows[i][1]
            out["sst"] = shared_strings(data, tuple(cuts), out["page"])
        elif kind == BOUNDSHEET:
            entry = sheet_entry(body, out["page"])
            out["sheets"] += [entry] if entry else []
        elif kind == EOF:
            break
        i += 1
    return out


def shared_strings(data: bytes, cuts: tuple[int, ...], page: int) -> list[str]:
    if len(data) < 8:
        return []
    out, at = [], 8
    for _ in range(struct.unpack_from("<I", data, 4)[0]):
        if at + 3 > len(data):
            break
        s, at = read_string(data, at, page, cuts)
        out.append(s)
    return out


def sheet_entry(body: bytes, page: int) -> dict | None:
    if len(body) < 8:
        return None
    offset, visibility, kind, n, wide = struct.unpack_from("<IBBBB", body)
    size = 2 * n if wide & 1 else n
    if len(body) < 8 + size:
        return None
    raw = body[8 : 8 + size]
    return {"name": decode_utf16(raw) if wide & 1 else decode_bytes(raw, page), "offset": offset, "visibility": visibility, "sheet_type": kind}


def sheet_cells(stream: bytes, offset: int, page: int) -> list[dict]:
    """Cells of one sheet: kind "sst" (index), "num" (value and style), or "text"."""
    cells: list[dict] = []
    if offset + 4 > len(stream) or struct.unpack_from("<H", stream, offset)[0] != BOF:
        return cells

    def put(row, col, kind, text=None, num=None, index=None, xf=None):
        cells.append({"row": row, "col": col, "kind": kind, "text": text, "num": num, "sst": index, "xf": xf})

    waiting = None  # a formula whose string comes in a later record
    first = True
    for kind, b in records(stream, offset):
        if first:
            first = False
            continue
        n = len(b)
        row, col, xf = struct.unpack_from("<HHH", b) if n >= 6 else (0, 0, 0)
        if kind == EOF:
            break
        if kind == LABELSST and n >= 10:
            put(row, col, "sst", index=struct.unpack_from("<I", b, 6)[0])
        elif kind in (LABEL, RSTRING) and n >= 8:
            put(row, col, "text", read_string(b, 6, page)[0])
        elif kind == NUMBER and n >= 14:
            put(row, col, "num", num=struct.unpack_from("<d", b, 6)[0], xf=xf)
        elif kind == RK and n >= 10:
            put(row, col, "num", num=rk_number(struct.unpack_from("<I", b, 6)[0]), xf=xf)
        elif kind == MULRK and n >= 6:
            for c in range(col, struct.unpack_from("<H", b, n - 2)[0] + 1):
                at = 4 + 6 * (c - col)
                if at + 6 > n - 2:
                    break
                style, rk = struct.unpack_from("<HI", b, at)
                put(row, c, "num", num=rk_number(rk), xf=style)
        elif kind == FORMULA and n >= 20:
            if b[12:14] == b"\xff\xff":
                if b[6] == 0:
                    waiting = (row, col)
                elif b[6] == 1:
                    put(row, col, "text", "TRUE" if b[8] else "FALSE")
                elif b[6] == 3:
                    put(row, col, "text", "")
            else:
                put(row, col, "num", num=struct.unpack_from("<d", b, 6)[0], xf=xf)
        elif kind == STRING:
            if waiting and n >= 3:
                put(*waiting, "text", read_string(b, 0, page)[0])
            waiting = None
        elif kind == BOOLERR and n >= 8:
            if b[7] == 0:
                put(row, col, "text", "TRUE" if b[6] else "FALSE")
        elif kind not in (CONTINUE, LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, BOOLERR):
            waiting = None
    return cells


MAX_GRID = 1_000_000


def grid_rows(cells: list[dict]) -> list[list[dict]]:
    """Cells by absolute row, the last one of each place; no rows where the grid would be too large."""
    if not cells or (max(c["row"] for c in cells) + 1) * (max(c["col"] for c in cells) + 1) > MAX_GRID:
        return []
    rows: list[dict[int, dict]] = [{} for _ in range(max(c["row"] for c in cells) + 1)]
    for c in cells:
        rows[c["row"]][c["col"]] = c
    return [[r[k] for k in sorted(r)] for r in rows]


def read_xls(data: bytes) -> dict:
    book = CompoundFile(data)
    stream = book.stream("Workbook") if book.has("Workbook") else book.stream("Book")
    out = _globals(stream)
    out["sheets"] = [s | {"rows": grid_rows(sheet_cells(stream, s["offset"], out["page"])) if s["visibility"] == 0 and s["sheet_type"] == 0 else []} for s in out["sheets"]]
    return {k: out[k] for k in ("sst", "formats", "xfs", "sheets")}


# ── legacy Word ──

_PUNCTUATION = {*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)}
_WIDE_HINT = {0x20, 0x0D} | _PUNCTUATION


def block_is_wide(block: bytes) -> bool:
    """Whether a block looks like UTF-16: an ASCII space, return or mark with a zero byte after it."""
    return any(block[i] in _WIDE_HINT and block[i + 1] == 0 for i in range(0, len(block) - 1, 2))


def word_units(data: bytes, wide: bool, page: int) -> str:
    """The character stream: 256-byte blocks, each UTF-16 or one byte a character.  Surrogates stay single."""
    if not wide:
        return decode_bytes(data, page)
    out = []
    for i in range(0, len(data), 256):
        block = data[i : i + 256]
        out.append("".join(map(chr, struct.unpack(f"<{len(block) // 2}H", block[: len(block) // 2 * 2]))) if block_is_wide(block) else decode_bytes(block, page))
    return "".join(out)


def join_surrogates(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def field_url(instruction: str) -> str | None:
    """The URL after the first HYPERLINK keyword, quoted or bare."""
    rest = re.search(HYPERLINK_REST, instruction)
    m = rest and re.match(HYPERLINK_URL, rest[1])
    return (m[1] or m[2] or None) if m else None


def word_paragraphs(units: str) -> list[str]:
    """Paragraphs of the character stream.  Fields nest: an instruction up to a separator, then what is
    shown; a HYPERLINK's becomes a markdown link, instructions go."""
    out, paragraph = [], []
    fields: list[list] = []  # [is shown, url, characters]
    for ch in join_surrogates(units):
        c = ord(ch)
        if c == 0x13:
            fields.append([False, None, []])
        elif c == 0x14:
            if fields:
                shown, _, text = fields[-1]
                fields[-1] = [True, None if shown else field_url("".join(text).strip()), []]
        elif c == 0x15:
            if fields:
                shown, url, text = fields.pop()
                if shown:
                    paragraph.append(f"[{''.join(text).strip()}]({url})" if url else "".join(text))
        elif fields:
            if c in (0x0D, 0x0B):
                fields[-1][2] = []
            elif c >= 0x20:
                fields[-1][2].append(ch)
        elif 0x0B <= c <= 0x0D:
            out.append("".join(paragraph))
            paragraph = []
        elif c in (0x07, 0x09):
            paragraph.append("\t")
        elif c == 0x1E:
            paragraph.append("-")
        elif c >= 0x20 and c != 0xFEFF:
            paragraph.append(ch)
    out.append("".join(paragraph))
    return out


def read_doc(data: bytes) -> dict:
    file = CompoundFile(data)
    if not file.has("WordDocument"):
        raise ValueError("no WordDocument stream")
    s = file.stream("WordDocument")
    if len(s) < 32:
        raise ValueError("WordDocument stream too short")
    lid, flags = struct.unpack_from("<H", s, 6)[0], struct.unpack_from("<H", s, 10)[0]
    if flags & 0x0100:
        raise ValueError("document is encrypted")
    start, end = struct.unpack_from("<II", s, 24)
    if not start < end <= len(s):
        raise ValueError("bad text bounds")
    page = LANGUAGES.get(lid & 1023, 1252)
    return {"paragraphs": word_paragraphs(word_units(s[start:end], bool(flags & 0x1000), page))}
