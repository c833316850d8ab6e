"""Signatures of files and images, base64 references, code pages."""

from __future__ import annotations

import codecs
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

OLE2, PDF, ZIP = "D0CF11E0A1B11AE1", "255044462D", "504B0304"
MAX_BYTES = 256 << 20


def starts(c, prefix: str) -> Column:
    """Whether a binary column starts with bytes given in hex."""
    return F.startswith(F.hex(F.substring(_c(c), 1, len(prefix) // 2)), F.lit(prefix))


def container(c) -> Column:
    """"ole2", "pdf", "zip" by magic bytes; else null."""
    return F.when(starts(c, OLE2), "ole2").when(starts(c, PDF), "pdf").when(starts(c, ZIP), "zip")


def image_mime(c) -> Column:
    """MIME type by magic bytes; null for what browsers can't show."""
    c = _c(c)
    head = F.hex(F.substring(c, 1, 12))
    size = F.octet_length(c)
    svg = F.hex(F.substring(c, 1, 256)).rlike("^(..)*?3C737667") & F.substring(c, 1, 256).isNotNull()
    text = F.try_validate_utf8(F.substring(c, 1, 256)).isNotNull()
    return (
        F.when(size < 4, None)
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47"), "image/png")
        .when((size >= 6) & head.startswith("474946"), "image/gif")
        .when((size >= 12) & head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("3C") & svg & text, "image/svg+xml")
    )


def image_inline(label) -> Column:
    return F.concat(F.lit("![]["), _c(label), F.lit("]"))


def image_definition(label, mime, data) -> Column:
    encoded = F.regexp_replace(F.base64(_c(data)), r"\s", "")
    return F.concat(F.lit("["), _c(label), F.lit("]: <data:"), _c(mime), F.lit(";base64,"), encoded, F.lit(">"))


#: Code page -> codec; any other id is Windows 1252, and 437 is read as 866.
CODECS = {437: "cp866", 874: "cp874", 932: "shift_jis", 936: "gbk", 949: "euc_kr", 950: "big5", 1250: "cp1250", 1251: "cp1251", 1253: "cp1253", 1254: "cp1254", 1255: "cp1255", 1256: "cp1256", 1257: "cp1257", 1258: "cp1258", 10000: "mac_roman", 20866: "koi8_r", 21866: "koi8_u", 28592: "iso8859_2", 28595: "iso8859_5", 28597: "iso8859_7", 28598: "iso8859_8", 65001: "utf_8"}
#: Primary language id -> code page; any other is 1252.
LANGUAGES = {4: 936, 17: 932, 18: 949, 25: 1251, 34: 1251, 35: 1251, 26: 1250, 5: 1250, 14: 1250, 21: 1250, 27: 1250, 36: 1250, 37: 1257, 38: 1257, 39: 1257, 8: 1253, 31: 1254, 13: 1255, 1: 1256, 41: 1256, 42: 1258, 30: 874}
#: Code pages in which a byte alone can't stand for a character above 0x7F.
_MULTIBYTE = {932, 936, 949, 950, 65001}


@functools.lru_cache(64)
def page_table(page: int) -> str:
    """256 characters, one a byte.  Bytes that a Windows page leaves open are C1 controls, as on the web;
    bytes without a character are U+FFFD."""
    codec = CODECS.get(page, "cp1252")
    out = []
    for b in range(256):
        raw = bytes([b])
        try:
            ch = codecs.decode(raw, codec) if b >= 0x80 else chr(b)
        except UnicodeDecodeError:
            open_c1 = codec.startswith("cp12") and 0x80 <= b <= 0x9F
            ch = chr(b) if open_c1 else "�"
        out.append(ch[0] if ch else "�")
    if codec == "gbk":
        out[0x80] = "€"  # the web's table has the euro sign here
    if codec == "shift_jis":
        out[0x80] = "\x80"
    return "".join(out)


def decode_bytes(data: bytes, page: int) -> str:
    table = page_table(page)
    return "".join([table[b] for b in data])


def language_page(lid) -> Column:
    """The code page of a language id."""
    primary = _c(lid).cast("int").bitwiseAND(F.lit(1023))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), primary), F.lit(1252))


def decode_page(data, page: int) -> Column:
    """Text of a binary column in a one-byte code page: the table is a literal, the work Catalyst's."""
    table = F.array(*[F.lit(ch) for ch in page_table(page)])
    codes = F.transform(F.filter(F.split(F.hex(_c(data)), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.array_join(F.transform(codes, lambda b: F.get(table, b)), "")
