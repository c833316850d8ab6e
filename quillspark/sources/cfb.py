"""Streams of OLE2 compound files, and a writer for fixtures."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE, _END, _FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


class CompoundFile:
    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini_size = 1 << struct.unpack_from("<H", data, 32)[0]
        if not 128 <= self.size <= 1 << 16 or not 16 <= self.mini_size <= self.size:
            raise ValueError("bad sector size")
        n_fat, first_dir, self.cutoff, first_mini, first_difat, n_difat = (struct.unpack_from("<I", data, at)[0] for at in (44, 48, 56, 60, 68, 72))
        difat = list(struct.unpack_from("<109I", data, 76))
        at, seen = first_difat, 0
        while at < _FAT and seen <= n_difat:
            row = struct.unpack(f"<{self.size // 4}I", self._sector(at))
            difat += row[:-1]
            at, seen = row[-1], seen + 1
        self.fat: list[int] = []
        for s in difat[: max(n_fat, 0)]:
            if s < _FAT:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        directory = self._chain(first_dir)
        self.entries: list[tuple[str, int, int, int]] = []
        for i in range(0, len(directory) - 127, 128):
            e = directory[i : i + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            name = e[: max(0, min(64, n) - 2)].decode("utf-16-le", "replace")
            kind = e[66]
            start, length = struct.unpack_from("<IQ", e, 116)
            self.entries.append((name, kind, start, length & 0xFFFFFFFF if self.size == 512 else length))
        roots = [e for e in self.entries if e[1] == 5]
        self.mini = self._chain(roots[0][2])[: roots[0][3]] if roots and roots[0][2] < _FAT else b""
        mini_fat = self._chain(first_mini) if first_mini < _FAT else b""
        self.mini_fat = struct.unpack(f"<{len(mini_fat) // 4}I", mini_fat)

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at >= len(self.data):
            raise ValueError("sector beyond the file")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, first: int) -> bytes:
        out, at, seen = [], first, set()
        while at < _FAT:
            if at in seen or at >= len(self.fat):
                raise ValueError("broken sector chain")
            seen.add(at)
            out.append(self._sector(at))
            at = self.fat[at]
        return b"".join(out)

    def has(self, name: str) -> bool:
        return any(e[0].lower() == name.lower() and e[1] == 2 for e in self.entries)

    def stream(self, name: str) -> bytes:
        for n, kind, first, length in self.entries:
            if n.lower() == name.lower() and kind == 2:
                if length >= self.cutoff:
                    return self._chain(first)[:length]
                out, at, seen = [], first, set()
                while at < _FAT and len(out) * self.mini_size < length:
                    if at in seen or at >= len(self.mini_fat):
                        raise ValueError("broken mini sector chain")
                    seen.add(at)
                    out.append(self.mini[at * self.mini_size : (at + 1) * self.mini_size])
                    at = self.mini_fat[at]
                return b"".join(out)[:length]
        raise ValueError(f"no stream {name}")


def write(streams: dict[str, bytes]) -> bytes:
    """A compound file of these streams, each in sectors of its own (padded past the mini cutoff)."""
    size = 512
    body, fat, entries = [], [], []

    def put(data: bytes) -> int:
        n = max(1, -(-len(data) // size))
        first = len(fat)
        fat.extend([first + i + 1 for i in range(n - 1)] + [_END])
        body.append(data.ljust(n * size, b"\0"))
        return first

    for name, data in streams.items():
        first = put(data.ljust(4096, b"\0"))
        entries.append((name, 2, first, max(len(data), 4096)))
    root = [("Root Entry", 5, _END, 0), *entries]
    directory = b""
    for i, (name, kind, first, length) in enumerate(root):
        raw = name.encode("utf-16-le") + b"\0\0"
        right = i + 1 if 0 < i < len(root) - 1 else _FREE
        child = 1 if i == 0 and len(root) > 1 else _FREE
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, _FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", first, length)
    while len(directory) % size:
        directory += b"\0" * 64 + struct.pack("<HBBIII", 0, 0, 1, _FREE, _FREE, _FREE) + b"\0" * 36 + struct.pack("<IQ", 0, 0)
    first_dir = put(directory)
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * size:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("too large for this writer")
    at = len(fat)
    fat += [_FAT] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    difat = [at + i for i in range(n_fat)] + [_FREE] * (109 - n_fat)
    header = MAGIC + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first_dir, 0, 4096, _END, 0, _END, 0) + struct.pack("<109I", *difat)
    return header + b"".join(body) + table
