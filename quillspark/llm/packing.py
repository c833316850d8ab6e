"""Packing documents into sequences of a fixed number of tokens.

A document's ids (its text's, then an end id) are cut into full pieces, which fill a sequence each,
and a remainder.  Documents are dealt at random into groups of about `group_docs`; each group packs
its remainders by first-fit decreasing, with a tournament tree over the bins' free space that finds
the first bin with room in logarithmic time.  What space is left is then filled by cutting up the
least filled bins, so a group has at most one sequence that is not full.

Defined results: null or empty text is the end id alone; rows with equal ids are packed as separate
documents; equal rows are dealt apart, so no group grows with them; an empty table gives no rows;
long texts are tokenized whole; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import mix, slices

END_ID = 0


class BinTree:
    """Free space of bins 0, 1, ... under a tournament tree: a node holds its leaves' maximum."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.space = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, whose space it takes."""
        space, k = self.space, 1
        while k < self.leaves:
            k = 2 * k if space[2 * k] >= size else 2 * k + 1
        free = space[k] - size
        bin_, space[k] = k - self.leaves, free
        while k > 1:
            k //= 2
            top = max(space[2 * k], space[2 * k + 1])
            if space[k] == top:
                break
            space[k] = top
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into sizes, which fall."""
    tree, bins = BinTree(len(sizes), capacity), []
    for i, size in enumerate(sizes):
        b = tree.place(size)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Moves (item, start, length) spans out of the least filled bins, cutting them where need be,
    until all bins but one are full."""
    room = [capacity - sum(x[2] for x in b) for b in bins]
    order = sorted((k for k in range(len(bins)) if room[k]), key=lambda k: (-room[k], k))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        giver, taker = order[lo], order[hi]
        if not room[taker]:
            hi -= 1
        elif not bins[giver]:
            lo += 1
        else:
            item, start, length = bins[giver].pop()
            part = min(length, room[taker])
            bins[taker].append((item, start, part))
            room[taker] -= part
            if part < length:
                bins[giver].append((item, start + part, length - part))
    return [b for b in bins if b]


def hash_row(name, ids: np.ndarray, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8, key=f"{seed} {name}".encode()[:64]).digest(), "little")


def deal(row: int, twin: int, task: int, groups: int) -> int:
    """The group of the n-th copy of a row in a task: neither copies in one task nor the n-th ones of all tasks meet."""
    key = np.array([row], np.uint64) + np.array([twin], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([task], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return int(mix(key)[0] % np.uint64(groups))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, group_docs: int = 2048, seed: int = 17, json_name: str = tokens.BPE_JSON, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and its ids
    (little-endian unsigned 32-bit) if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, -(-rows.count() // group_docs))

    def cut(batches):
        seen: Counter = Counter()  # by a hash of the row: copies of it in this task so far
        task = TaskContext.get().partitionId() + 1
        for part, _, _ in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            names = part.column(0).to_pylist()
            for name, ids in zip(names, tokens.bpe_ids([t or "" for t in part.column(1).to_pylist()], json_name)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                row = hash_row(name, ids, seed)
                twin, seen[row] = seen[row], seen[row] + 1  # equal rows are interchangeable, so their order doesn't matter
                grp = deal(row, twin, task, groups)
                full = len(ids) // capacity * capacity
                for at in [*range(0, full, capacity), *([full] if full < len(ids) else [])]:
                    piece = ids[at : at + capacity].tobytes()
                    whole = len(piece) == 4 * capacity
                    values = (grp, name, at, len(piece) // 4, zlib.crc32(piece), len(ids), piece if with_ids or not whole else None)
                    for column, v in zip(out.values(), values):
                        column.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("grp", pa.int64()), ("doc_id", part.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))

    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def arrange(group: pa.Table) -> pa.Table:
        return _arrange(group, capacity, with_ids)

    pieces = rows.mapInArrow(cut, f"grp long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    packed = pieces.groupBy("grp").applyInArrow(arrange, columns).withColumnRenamed("doc_id", doc_id)
    return packed if with_ids else packed.drop("ids")


def _arrange(group: pa.Table, capacity: int, with_ids: bool) -> pa.Table:
    rows = group.select(["grp", "start", "length", "ids_crc32", "doc_tokens", "ids"]).to_pylist()
    names = group.column("doc_id").to_pylist()
    at = sorted(range(len(rows)), key=lambda i: (-rows[i]["length"], names[i] is None, names[i] if names[i] is not None else 0, rows[i]["start"], rows[i]["ids_crc32"], rows[i]["doc_tokens"]))
    whole = [i for i in at if rows[i]["length"] == capacity]
    rest = [i for i in at if rows[i]["length"] < capacity]
    bins = first_fit_decreasing([rows[i]["length"] for i in rest], capacity)
    sequences = [[(i, 0, capacity)] for i in whole] + fill([[(rest[k], 0, rows[rest[k]]["length"]) for k in b] for b in bins], capacity)
    base = (rows[0]["grp"] if rows else 0) << 24
    out: dict[str, list] = {k: [] for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
    of = []
    for k, spans in enumerate(sequences):
        offset = 0
        for i, start, length in spans:
            r = rows[i]
            ids = r["ids"][4 * start : 4 * (start + length)] if r["ids"] is not None else None
            crc = r["ids_crc32"] if length == r["length"] else zlib.crc32(ids)
            of.append(i)
            for column, v in zip(out.values(), (r["start"] + start, length, crc, r["doc_tokens"], base + k, offset, ids if with_ids else None)):
                column.append(v)
            offset += length
    name_column = group.column("doc_id").combine_chunks().take(pa.array(of, pa.int64()))
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.Table.from_arrays([name_column, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["doc_id", *out])
