"""ZIP parts and a forgiving XML tree.

A tree is built from expat's events.  Where the XML breaks off or is not well formed, what was read up
to there is kept and open elements count as closed."""

from __future__ import annotations

import io
import zipfile
from xml.parsers import expat

#: Most bytes that one part may inflate to.
MAX_PART = 256 << 20


class Node:
    __slots__ = ("name", "attrs", "kids", "broken")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids, self.broken = name.rpartition(":")[2], attrs, [], False

    def elements(self):
        return (k for k in self.kids if isinstance(k, Node))

    def all(self, *names: str):
        """Descendants of these names in document order; also those inside each other."""
        for k in self.elements():
            if k.name in names:
                yield k
            yield from k.all(*names)

    def outermost(self, *names: str):
        """As all(), but not inside one that was found."""
        for k in self.elements():
            if k.name in names:
                yield k
            else:
                yield from k.outermost(*names)

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def get(self, *names: str) -> str | None:
        """The first of these attributes, by its name with the prefix."""
        return next((self.attrs[n] for n in names if n in self.attrs), None)


def parse(data: bytes) -> Node:
    root = Node("", {})
    stack = [root]
    p = expat.ParserCreate()
    p.buffer_text = True

    def start(name, attrs):
        n = Node(name, attrs)
        stack[-1].kids.append(n)
        stack.append(n)

    p.StartElementHandler = start
    p.EndElementHandler = lambda name: stack.pop()
    p.CharacterDataHandler = lambda text: stack[-1].kids.append(text)
    try:
        p.Parse(data, True)
    except expat.ExpatError:
        root.broken = True
    return root


class Parts:
    """The parts of a ZIP container."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = {i.filename: i for i in self.zip.infolist()}

    def read(self, name: str) -> bytes | None:
        info = self.names.get(name)
        if info is None:
            return None
        if info.file_size > MAX_PART:
            raise ValueError(f"part {name} inflates to more than {MAX_PART} bytes")
        return self.zip.read(info)

    def must(self, name: str) -> bytes:
        data = self.read(name)
        if data is None:
            raise ValueError(f"no part {name}")
        return data

    def tree(self, name: str) -> Node | None:
        data = self.read(name)
        return None if data is None else parse(data)


def rels_name(part: str) -> str:
    folder, slash, name = part.rpartition("/")
    return f"{folder}{slash}_rels/{name}.rels"


def relationships(parts: Parts, part: str) -> list[dict]:
    """The relationships of a part; none if there is no such list."""
    tree = parts.tree(rels_name(part))
    return [{"rid": n.get("Id") or "", "target": n.get("Target") or "", "type": n.get("Type") or "", "mode": n.get("TargetMode") or ""} for n in tree.all("Relationship")] if tree else []


def resolve(target: str, folder: str) -> str:
    """A target relative to a folder; absolute targets drop their slashes only."""
    if target.startswith("/"):
        return target.lstrip("/")
    out: list[str] = []
    for s in f"{folder}/{target}".split("/"):
        if s == "..":
            del out[-1:]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


def is_image(rel: dict) -> bool:
    return rel["type"].endswith("/image") and bool(rel["rid"]) and bool(rel["target"])
