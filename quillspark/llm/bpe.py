"""Byte-level BPE by corpus-level merge replay.

Texts are split at single spaces between other characters, where the pre-tokenizer's pattern always
splits too.  Every distinct piece of the corpus is encoded once:

1. Chunks: a task turns its documents, a few megabytes at a time, into their distinct pieces and each
   document's indexes into them, and asks the buckets of a hash for the pieces' ids.
2. Replay: a bucket's task matches its distinct pieces by the pattern; the distinct matches become one
   array of byte ids with links to both neighbours.  An inverted index holds, by the rank of a pair of
   adjacent ids, the places where it stands.  Ranks are replayed in rising order; a merge is applied at
   all its places at once and files only the pairs with the touched neighbours.  Each chunk is answered.
3. A chunk meets its answers, and its documents' ids are put together from them; digests of the decoded
   bytes are taken of what these ids stand for.

A merge may in principle create a pair of a lower rank than its own.  The library would then apply
that one first, so words where this happens are encoded one by one with the plain rule.

The chunk table is written to the shared folder, so a lost executor's work is redone from there.  It lies
in buckets of its chunks: only requests and answers travel, the documents' numbers stay where they are.

Defined results: null or empty text: no ids, empty bytes; rows are encoded each for itself, so
repeated rows give equal results; an empty table gives no rows; long texts are encoded whole; other
columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bucketed_table, slices, with_columns

CHUNK_BYTES = 16 << 20
PART_BYTES = 16 << 20  # of text for each partition of buckets and of chunks
TOGETHER = 2  # bits: four chunks of a task lie in one file and are finished together
#: Below it, str.isalpha() and the pattern's \\p{L} agree (tests try each character).
_LETTERS_END = "\u0250"
_PLAIN = re.compile(r"\s | \s|^ | $")
_TRUE = np.ones(1, bool)
_BESIDE = [x for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for x in (c + " ", " " + c)]
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _plain(text: str) -> bool:
    """Whether all spaces stand alone between other characters."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return False
    return not any(x in text for x in _BESIDE) if text.isascii() else not _PLAIN.search(text)


class Ranks:
    """A rank file as arrays: the id of each byte, and the merged id of each pair of ids."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex

        ranks = tokens.load_ranks(name)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in ranks.values()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair; -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def plain(self, word: bytes) -> list[int]:
        """One word by the library's rule: the lowest rank first, the leftmost of equal ones."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


@functools.lru_cache(2)
def load(name: str) -> Ranks:
    return Ranks(name)


def replay(words: list[bytes], r: Ranks) -> list[list[int]]:
    """Ids of each (non-empty) word."""
    if not words:
        return []
    lengths = np.array([len(w) for w in words], np.int64)
    ids = r.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(ids)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    after = np.arange(1, n + 1)
    after[ends - 1] = n  # n: no neighbour
    before = np.arange(-1, n - 1)
    before[ends - lengths] = n
    alive = np.ones(n + 1, bool)
    alive[n] = False
    ids = np.append(ids, -1)
    odd: set[int] = set()
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def file(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])[: len(ranks)])
        cuts = heads.tolist() + [len(ranks)]
        for k, rank in enumerate(ranks[heads].tolist()):
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(places[cuts[k] : cuts[k + 1]])

    left = np.flatnonzero(after < n)
    ranks = r.rank_of(ids[left], ids[after[left]])
    file(left[ranks >= 0], ranks[ranks >= 0])
    while queue:
        rank = heapq.heappop(queue)
        at = np.sort(np.concatenate(index.pop(rank)))
        at = at[alive[at] & np.concatenate([_TRUE, at[1:] != at[:-1]])]
        to = after[at]
        ok = to < n
        at, to = at[ok], to[ok]
        ok = r.rank_of(ids[at], ids[to]) == rank  # a neighbour may have changed since
        at, to = at[ok], to[ok]
        if not len(at):
            continue
        chained = np.concatenate([~_TRUE, at[1:] == to[:-1]])
        if chained.any():  # a run of one id: the leftmost pairs take precedence
            heads = np.flatnonzero(~chained)
            place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            at, to = at[place % 2 == 0], to[place % 2 == 0]
        ids[at] = rank
        alive[to] = False
        nxt = after[to]
        after[at] = nxt
        has = nxt < n
        before[nxt[has]] = at[has]
        prev = before[at]
        around = [(prev[prev < n], at[prev < n])] + [(at[has], nxt[has])]
        a = np.concatenate([x for x, _ in around])
        b = np.concatenate([y for _, y in around])
        new = r.rank_of(ids[a], ids[b])
        low = (new >= 0) & (new <= rank)
        if low.any():
            odd.update(word[a[low]].tolist())
        keep = new > rank
        file(a[keep], new[keep])
    kept = np.flatnonzero(alive[:n])
    flat, cuts = ids[kept].tolist(), [0, *np.searchsorted(kept, ends).tolist()]
    out = [flat[cuts[i] : cuts[i + 1]] for i in range(len(words))]
    for i in odd:
        out[i] = r.plain(words[i])
    return out


def pieces_of(text: str) -> list[str]:
    """A text's pieces.  A piece leaves out the space before it, but the first of a text, which has none, gets one."""
    p = text.split(" ") if _plain(text) else _CUT.split(text)
    p[0] = " " + p[0]
    return p


def learn(pieces: list[str], r: Ranks) -> list[list[int]]:
    """The ids of each (distinct) piece, by replay of their distinct matches."""
    match = r.pattern.findall
    words: dict[str, int] = {}
    number = words.setdefault
    of = []
    for p in pieces:
        if p.isalpha() and max(p) < _LETTERS_END:  # letters: one match, space and all
            of.append((number(" " + p, len(words)),))
        else:
            of.append([number(w, len(words)) for w in match(p[1:] if p[:1] == " " else " " + p)])
    ids = replay([w.encode() for w in words], r)
    return [ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for ws in of]


#: Between pieces in a packed list: no text has it, as UTF-8 can't hold a lone surrogate.
_BETWEEN = "\ud800"
_ZSTD = pa.Codec("zstd", compression_level=3)


def pack_pieces(pieces: list[str]) -> tuple[bytes, int]:
    """Pieces as compressed bytes, and their size before."""
    raw = _BETWEEN.join(pieces).encode("utf-8", "surrogatepass")
    return _ZSTD.compress(raw, asbytes=True), len(raw)


def unpack_pieces(body: bytes, size: int) -> list[str]:
    return _ZSTD.decompress(body, size, asbytes=True).decode("utf-8", "surrogatepass").split(_BETWEEN)


def pack_numbers(*numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed byte planes."""
    flat = np.concatenate(numbers).astype("<u4")
    return _ZSTD.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpack_numbers(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(body, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Index(dict):
    def __missing__(self, piece):
        n = self[piece] = len(self)
        return n


def _runs(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes starts[0], ... of counts[0] length, and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def decode_ids(ids: np.ndarray, r: Ranks) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(r.bytes_of.__getitem__, ids.tolist()))


def _chunked(buckets: int):
    """Rows of kind 0: a chunk's doc_ids, pieces a document, and in `body` the place by bucket of each of its distinct
    pieces, then the documents' indexes into these; of kind 1: the pieces that it asks a bucket for, packed."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        index, names, flat, lengths, size, id_type = _Index(), [], [], [], 0, None

        def flush():
            sorted_pieces = sorted(index)  # neighbours share their beginnings, which packs well
            at = np.fromiter((zlib.crc32(p.encode()) % buckets for p in sorted_pieces), np.int64, len(sorted_pieces))
            order = np.argsort(at, kind="stable")
            pieces = [sorted_pieces[i] for i in order.tolist()]
            number_of = np.empty(len(pieces), "<u4")
            number_of[np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))] = np.arange(len(pieces))
            body = pack_numbers(number_of, *flat)  # pieces count up as they come, so that frequent ones have small numbers
            chunk = part << 32 | number
            met, heads = np.unique(at[order], return_index=True)
            cuts = [*heads.tolist(), len(order)]
            asked = [pack_pieces(pieces[cuts[k] : cuts[k + 1]]) for k in range(len(met))]
            n, none = len(met), [None] * len(met)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([0] + [1] * n, pa.int32()), pa.array([chunk] * (n + 1), pa.int64()), pa.array([None, *met.tolist()], pa.int64()),
                    pa.array([names, *none], pa.list_(id_type)), pa.array([lengths, *none], pa.list_(pa.int64())), pa.array([body, *(b for b, _ in asked)], pa.binary()), pa.array([0, *(size for _, size in asked)], pa.int64()),
                ],
                ["kind", "chunk", "bucket", "names", "lengths", "body", "size"],
            )

        for rows, _, offsets in slices(batches, "text"):
            id_type = rows.schema.field(0).type
            names += rows.column(0).to_pylist()
            for t in rows.column(1).to_pylist():
                p = pieces_of(t or "")
                flat.append(np.fromiter(map(index.__getitem__, p), np.uint32, len(p)))
                lengths.append(len(p))
            size += int(offsets[-1])
            if size >= CHUNK_BYTES:
                yield flush()
                number += 1
                index, names, flat, lengths, size = _Index(), [], [], [], 0
        if names:
            yield flush()

    return run


def _answers(ranks_name: str):
    """For rows sorted by bucket: each chunk's answer, the number of ids of each piece and the ids."""

    def run(batches):
        r = load(ranks_name)

        def answer(asked):
            index = _Index()
            where = [np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces)) for _, pieces in asked]
            ids = learn(list(index), r)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), "<u4", int(counts.sum()))
            starts = np.cumsum(counts) - counts
            for (chunk, _), at in zip(asked, where):
                n = counts[at]
                mine = flat[_runs(n, starts[at])]
                yield chunk, bucket, len(at), pack_numbers(n, mine), len(at) + len(mine)

        def out(rows):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["chunk", "bucket", "n", "body", "size"])

        bucket, asked = None, []
        for batch in batches:
            for b, chunk, body, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if b != bucket and asked:
                    yield out(list(answer(asked)))
                    asked = []
                bucket = b
                asked.append((chunk, unpack_pieces(body.as_py(), size)))
        if asked:
            yield out(list(answer(asked)))

    return run


def _encoded(docs: DataFrame, doc_id: str, text: str, ranks_name: str, columns: str, emit) -> DataFrame:
    """doc_id and `columns`: what emit gives for the names, ids and ranks of a chunk's documents."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    rows = rows.mapInArrow(_chunked(2 * wide), f"kind int, chunk long, bucket long, names array<{kind}>, lengths array<long>, body binary, size long")
    together = F.shiftright("chunk", TOGETHER).alias("together")  # neighbours of one task
    chunked = bucketed_table(rows.select("*", together), "bpe_chunks", "together", wide)
    asked = chunked.where("kind = 1").select("bucket", "chunk", "body", "size").repartition(wide, "bucket").sortWithinPartitions("bucket", "chunk")
    replies = asked.mapInArrow(_answers(ranks_name), "chunk long, bucket long, n long, body binary, size long").select("*", together)

    def finish(whole, replies):
        r, of = load(ranks_name), {}
        for chunk, _, i in sorted(zip(replies["chunk"].to_pylist(), replies["bucket"].to_pylist(), range(len(replies)))):
            of.setdefault(chunk, []).append(i)
        packed, sizes, met = replies["body"], replies["size"].to_pylist(), replies["n"].to_pylist()
        id_type, out = whole.schema.field("names").type.value_type, []
        for k, chunk in enumerate(whole["chunk"].to_pylist()):
            got = [(met[i], unpack_numbers(packed[i].as_py(), sizes[i])) for i in of.pop(chunk)]
            lengths = whole["lengths"][k].values.to_numpy()
            pieces = sum(n for n, _ in got)
            numbers = unpack_numbers(whole["body"][k].as_py(), pieces + int(lengths.sum()))
            order, flat = numbers[:pieces], numbers[pieces:]
            counts = np.concatenate([x[:n] for n, x in got]).astype(np.int64)
            ids = np.concatenate([x[n:] for n, x in got])
            starts = (np.cumsum(counts) - counts)[order]
            counts = counts[order]
            names = [" ".join(map(r.names.__getitem__, ids[a : a + n].tolist())) for a, n in zip(starts.tolist(), counts.tolist())]
            out += emit(pa.array(whole["names"][k].as_py(), id_type), flat, lengths, counts, starts, ids, names, r)
        return pa.Table.from_batches(out)

    whole = chunked.where("kind = 0").select("together", "chunk", "body", "names", "lengths")
    return whole.groupBy("together").cogroup(replies.groupBy("together")).applyInArrow(finish, f"doc_id {kind}, {columns}").withColumnRenamed("doc_id", doc_id)


def _documents(flat, lengths, counts, starts, ids):
    """(indexes of the pieces, ids) of each document of a chunk."""
    at = 0
    for n in lengths.tolist():
        piece = flat[at : at + n]
        at += n
        yield piece, ids[_runs(counts[piece], starts[piece])]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_name: str = tokens.BPE_RANKS) -> DataFrame:
    """doc_id, ids (array of int): each whole text's ids."""

    def emit(doc_ids, flat, lengths, counts, starts, ids, names, r):
        of = [x.astype(np.int32) for _, x in _documents(flat, lengths, counts, starts, ids)]
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(of, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _encoded(docs, doc_id, text, ranks_name, "ids array<int>", emit)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", ranks_name: str = tokens.BPE_RANKS) -> DataFrame:
    """doc_id, decoded (bytes): the bytes that the ids stand for.  Null ids decode to nothing."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches):
        r = load(ranks_name)
        for batch in batches:
            yield with_columns(batch, ["doc_id"], decoded=pa.array([decode_ids(np.array(x or (), np.int64), r) for x in batch.column(1).to_pylist()], pa.binary()))

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary").withColumnRenamed("doc_id", doc_id)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_name: str = tokens.BPE_RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes
    that these ids decode to): encoding and decoding without shipping the ids."""

    def emit(doc_ids, flat, lengths, counts, starts, ids, names, r):
        n, said, back = [], [], []
        for piece, of in _documents(flat, lengths, counts, starts, ids):
            n.append(len(of))
            said.append(hashlib.sha256(" ".join(map(names.__getitem__, piece.tolist())).encode()).hexdigest())
            back.append(hashlib.sha256(decode_ids(of, r)).hexdigest())
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, doc_id, text, ranks_name, "n_tokens long, ids_sha256 string, decoded_sha256 string", emit)
