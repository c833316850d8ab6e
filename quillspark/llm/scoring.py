"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A document's tokens are its words, A-Z lower-cased, then one end.  A token falls into a leaf: the most
frequent ones each have their own, others share one by a hash of their ending.  The model gives
p(token | context) = p(class | context) p(leaf | class, context) p(token | leaf); the softmaxes over
classes and over the leaves of a class score hashed features of the context: a bias, the word before
(bigram), the word before that (skip) and both together (trigram); in a leaf, tokens have add-one
probabilities, of which one share is for unknown ones.

Data flow; all of it grows with the input, and no text or table of words reaches the driver or one task:

1. Chunks: each task turns its documents into runs of a few megabytes: the run's distinct tokens, by
   bucket of their hash, and for each document their indexes.  They are written once, in files by chunk.
   From there each chunk asks, bucket by bucket, for the counts of its tokens and tells its training counts.
2. Counts: a bucket's task sums these and answers each chunk; it also tells its most frequent tokens
   and its totals by ending.
3. Statistics: how often each leaf follows each hashed context in training documents, from all chunks,
   added up by Spark.  Leaves, classes and context codes are sized from the counted vocabulary (Shape),
   so that the table grows with it; the weights, which the driver holds, grow as its power 2/3.
4. Training: each epoch sends the weights to the tasks that hold the statistics' partitions; their
   gradients are added up by blocks of features, and the driver takes a step (Adam) with the sum.
5. Scores: the answers go to the files of their chunks, which are read where they lie and scored in sparse
   numpy batches: of the weights only those of a position's four features and of its own class and leaf
   are read; what normalises them depends on the hashed context alone and is worked out once for each.

No task's memory grows with the input: a chunk, a bucket and the cells of a statistics part have fixed
sizes, and parts are merged as they come.

Defined results: null or empty text is the end token alone; a null doc_id is never held out; repeated
rows are scored alike, and count as often as they stand there; an empty table gives no rows; with no
training rows every token is unknown; long texts are read whole; other columns are never read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed_table, slices, stage_table

HELD_OUT_MOD, HELD_OUT = 7, 2
END = b""
CHUNK_BYTES, CHUNK_TOKENS = 4 << 20, 60_000
#: Leaves: own ones, then shared ones.  Contexts: start, own codes, then shared ones.
OWN, SHARED, CLASSES = 160, 96, 16
LEAVES = OWN + SHARED
H1_OWN, H1, H2_OWN, H2, H12 = 96, 128, 20, 32, 512
CONTEXTS = H1 * H2
FEATURES = 1 + H1 + H2 + H12
STAT_PARTS = 8
STEP = 1 << 15  # distinct training tokens up to which the sizes above hold; they double with each eightfold of it
BLOCK = 512  # contexts that are handled at once
POSITIONS = 1_000_000  # of a task that wait to be counted
PENDING = 1_000_000  # cells of a statistics part that wait to be added up
FEATURE_BLOCK = 64  # features whose gradients are added up together
BUCKET_BYTES = 32 << 20  # of text for each bucket of tokens
TOGETHER = 16 << 20  # bytes of a task's neighbouring chunks, up to which they lie in one file and are finished together


class Shape(NamedTuple):
    """Sizes of a model.  Cells of its statistics (contexts x leaves) grow in proportion to the vocabulary."""

    scale: int = 1

    @classmethod
    def of(cls, vocabulary: int, step: int | None = None, size: int = 1) -> Shape:
        return cls(size << max(0, (max(vocabulary, 1) // (step or STEP)).bit_length() - 1) // 3)

    own = property(lambda self: OWN * self.scale)
    shared = property(lambda self: SHARED * self.scale)
    leaves = property(lambda self: LEAVES * self.scale)
    classes = property(lambda self: CLASSES << (self.scale.bit_length() - 1) // 2)
    h1_own = property(lambda self: H1_OWN * self.scale)
    h1 = property(lambda self: H1 * self.scale)
    h2_own = property(lambda self: H2_OWN * self.scale)
    h2 = property(lambda self: H2 * self.scale)
    h12 = property(lambda self: H12 * self.scale)
    contexts = property(lambda self: self.h1 * self.h2)
    features = property(lambda self: 1 + self.h1 + self.h2 + self.h12)


SMALL = Shape()
_MARKS = b".,;:!?"


def ending(token: bytes) -> int:
    """Hash of a token's last bytes, and of whether punctuation follows them."""
    stem = token.rstrip(_MARKS)
    return zlib.crc32(stem[-3:] + (b"." if len(stem) < len(token) else b""))


class _Index(dict):
    def __missing__(self, token):
        n = self[token] = len(self)
        return n


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of counts, which mostly are of zeros."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _chunked(buckets: int, schema: pa.Schema):
    """For documents: chunks, with their tokens by bucket.  met: the buckets that have any; sizes: how many."""

    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0  # part, group, number in the group
        index, names, runs, train, size = _Index(), [], [], [], 0

        def flush():
            lengths = np.array([len(r) for r in runs], np.int32)
            tokens = list(index)
            kind = np.uint16 if len(tokens) <= 65536 else np.uint32
            at = np.array([zlib.crc32(t) % buckets for t in tokens], np.int64)
            order = np.argsort(at, kind="stable")
            place = np.empty(len(tokens), kind)
            place[order] = np.arange(len(tokens), dtype=kind)
            met, sizes = np.unique(at, return_counts=True)
            row = [chunk, names, lengths, train, b"\n".join([tokens[i] for i in order.tolist()]), met, sizes, place.itemsize, place[np.concatenate(runs)].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        def following(b):
            return (chunk + 1, held + b.nbytes) if held + b.nbytes < TOGETHER else (((chunk >> 16) + 1) << 16, 0)

        for batch, data, offsets in slices(batches, "text"):
            raw = data.tobytes().lower()  # of bytes: A-Z only
            ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (name, flag) in enumerate(zip(ids, flags)):
                words = raw[offsets[i] : offsets[i + 1]].split()
                words.append(END)
                runs.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                names.append(name)
                train.append(bool(flag))
                size += int(offsets[i + 1] - offsets[i])
                if size >= CHUNK_BYTES or len(index) >= CHUNK_TOKENS:
                    yield (b := flush())
                    chunk, held = following(b)
                    index, names, runs, train, size = _Index(), [], [], [], 0
        if runs:
            yield flush()

    return run


def _requests(batches):
    """For chunks: a row for each bucket that a chunk has tokens of, with these and their training counts."""
    for batch in batches:
        for chunk, lengths, train, tokens, met, sizes, width, body in zip(*(batch.column(i).to_pylist() for i in range(8))):
            use = np.repeat(np.array(train, bool), lengths)
            learn = np.bincount(np.frombuffer(body, f"<u{width}")[use], minlength=sum(sizes))
            ends = np.append(np.flatnonzero(np.frombuffer(tokens, np.uint8) == ord("\n")), len(tokens))
            upto = np.cumsum(sizes)
            stops = ends[upto - 1].tolist()
            asked = [tokens[i:j] for i, j in zip([0, *(x + 1 for x in stops)], stops)]
            told = [_planes(x) for x in np.split(learn, upto[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([chunk] * len(met), pa.int64()), pa.array(asked, pa.binary()), pa.array(told, pa.binary())], ["bucket", "chunk", "tokens", "body"])


def _answers(batches, most: Shape):
    """For rows sorted by bucket: counts for each request; the bucket's most frequent tokens; totals by shared
    leaf of the largest shape that the input may need, of whose leaves those of smaller shapes are made up."""
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def answer(bucket, asked):
        total: dict[bytes, int] = {}
        get = total.get
        for _, tokens, body in asked:
            for t, c in zip(tokens.split(b"\n"), _of_planes(body).tolist()):
                total[t] = get(t, 0) + c
        rows = [(0, chunk, bucket, _planes(np.fromiter(map(total.__getitem__, tokens.split(b"\n")), np.int64)), None, None, None) for chunk, tokens, _ in asked]
        seen = [(c, t) for t, c in total.items() if c]
        top = sorted(seen, key=lambda x: (-x[0], x[1]))[: most.own]
        rows += [(1, None, None, None, t, c, 1) for c, t in top]
        n, v = np.zeros(most.shared, np.int64), np.zeros(most.shared, np.int64)
        at = np.fromiter((ending(t) for _, t in seen), np.int64, len(seen)) % most.shared
        np.add.at(n, at, np.fromiter((c for c, _ in seen), np.int64, len(seen)))
        np.add.at(v, at, 1)
        rows += [(2, k, None, None, None, int(n[k]), int(v[k])) for k in np.flatnonzero(n).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["kind", "chunk", "bucket", "counts", "token", "n", "v"])

    at, asked = None, []
    for batch in batches:
        for i, (bucket, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if bucket != at and asked:
                yield answer(at, asked)
                asked = []
            at = bucket
            asked.append((chunk, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
    if asked:
        yield answer(at, asked)


class Codes:
    """Leaf and context codes of tokens.  Context codes of tokens without an own one hash the whole token."""

    def __init__(self, own: list[bytes], shape: Shape = SMALL):
        self.rank, self.shape = {t: i for i, t in enumerate(own)}, shape

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.shape
        rank = np.fromiter((self.rank.get(t, -1) for t in tokens), np.int64, len(tokens))
        end = np.fromiter(map(ending, tokens), np.int64, len(tokens))
        whole = np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens))
        leaf = np.where(rank >= 0, rank, s.own + end % s.shared)
        h1 = np.where((rank >= 0) & (rank < s.h1_own), 1 + rank, 1 + s.h1_own + whole % (s.h1 - 1 - s.h1_own))
        h2 = np.where((rank >= 0) & (rank < s.h2_own), 1 + rank, 1 + s.h2_own + whole % (s.h2 - 1 - s.h2_own))
        return leaf, h1, h2


def _contexts(flat: np.ndarray, lengths: np.ndarray, h1: np.ndarray, h2: np.ndarray, shape: Shape = SMALL) -> np.ndarray:
    """The context code of each position: codes of the two tokens before, 0 before a document's start."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    one, two = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    one[1:] = h1[flat[:-1]]
    two[2:] = h2[flat[:-2]]
    one[starts] = 0
    two[starts] = 0
    after = starts[lengths > 1] + 1
    two[after] = 0
    return one * shape.h2 + two


def features(context: np.ndarray, shape: Shape = SMALL) -> np.ndarray:
    """The four active features of each context."""
    a, b = context // shape.h2, context % shape.h2
    both = ((a * 2654435761 + b * 40503) >> 7) % shape.h12
    return np.stack([np.zeros_like(a), 1 + a, 1 + shape.h1 + b, 1 + shape.h1 + shape.h2 + both], 1)


def _scores(weights: np.ndarray, context: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Scores of classes, and of leaves by class."""
    f = features(context, shape)
    both = sum(weights[f[:, k]] for k in range(f.shape[1]))
    return both[:, : shape.classes], both[:, shape.classes :].reshape(len(context), shape.classes, -1)


def _norm(x: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials along the last axis."""
    top = x.max(-1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(-1, keepdims=True))


def log_softmaxes(weights: np.ndarray, context: np.ndarray, shape: Shape = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """log p(class | context), log p(leaf | its class, context)."""
    c, leaf = _scores(weights, context, shape)
    return c - _norm(c), leaf - _norm(leaf)


def gradient(weights: np.ndarray, context: np.ndarray, counts: np.ndarray, shape: Shape = SMALL, into: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Gradient of the log likelihood of counts[context, leaf], added to `into`, and the log likelihood."""
    lc, ll = log_softmaxes(weights, context, shape)
    by = counts.reshape(len(context), shape.classes, -1)
    n = by.sum(-1)
    dc = n - n.sum(1, keepdims=True) * np.exp(lc)
    dl = (by - n[:, :, None] * np.exp(ll)).reshape(len(context), shape.leaves)
    g = np.zeros_like(weights) if into is None else into
    f, d = features(context, shape), np.concatenate([dc, dl], 1)
    for k in range(f.shape[1]):
        order = np.argsort(f[:, k], kind="stable")
        at, heads = np.unique(f[order, k], return_index=True)
        g[at] += np.add.reduceat(d[order], heads)
    return g, float((n * lc).sum() + (by * ll).sum())


def _pack(code: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes and their counts, as compressed byte planes of the differences and of the counts."""
    planes = (np.diff(code, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T, n.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(b"".join(p.tobytes() for p in planes), 1)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(2, 8, -1)
    step, n = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes)
    return np.cumsum(step), n


def _sum(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, heads = np.unique(code[order], return_index=True)
    return code, np.add.reduceat(n[order], heads)


def _merge(batches):
    """For rows sorted by part: one row of statistics for each.  What has come is added up as it grows past
    twice the part's cells."""

    def row(part, codes, counts):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(*_sum(codes, counts))], pa.binary())], ["part", "body"])

    at, codes, counts, held, cells = None, [], [], 0, 0
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != at and codes:
                yield row(at, codes, counts)
                codes, counts, held, cells = [], [], 0, 0
            at = part
            code, n = _unpack(batch.column(1)[i].as_py())
            codes.append(code)
            counts.append(n)
            held += len(code)
            if held > 2 * cells + PENDING:
                code, n = _sum(codes, counts)
                codes, counts, held, cells = [code], [n], len(code), len(code)
    if codes:
        yield row(at, codes, counts)


def _add_up(rows: pa.Table) -> pa.Table:
    """The sum of a block's gradients, in an order of their own, so that a rerun gives the same model."""
    total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in sorted(rows.column("g").to_pylist()))
    return pa.table({"block": rows.column("block")[:1], "g": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def _train(stats: DataFrame, totals: np.ndarray, epochs: int, rate: float, l2: float, shape: Shape = SMALL) -> np.ndarray:
    """Adam over gradients that the tasks holding the statistics return.  stats: rows of packed codes
    (context * leaves + leaf) and counts, by hash of the trigram, so that tasks share few features."""
    spark = stats.sparkSession
    weights = np.zeros((shape.features, shape.classes + shape.leaves))
    share = np.log((totals + 1.0) / (totals + 1.0).sum()).reshape(shape.classes, -1)
    weights[0, : shape.classes] = np.log(np.exp(share).sum(1))
    weights[0, shape.classes :] = (share - weights[0, : shape.classes, None]).ravel()
    n = totals.sum()
    if not n:
        return weights
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    parts = stats.select("body").coalesce(max(STAT_PARTS, 2 * shape.scale))
    for epoch in range(1, epochs + 1):
        sent = spark.sparkContext.broadcast(weights.astype(np.float32))

        def grad(batches, sent=sent):
            g = np.zeros(sent.value.shape)
            for body in (x for b in batches for x in b.column(0).to_pylist()):
                code, k = _unpack(body)
                context, row = np.unique(code // shape.leaves, return_inverse=True)
                leaf = code % shape.leaves
                for i in range(0, len(context), BLOCK):
                    lo, hi = np.searchsorted(row, [i, i + BLOCK])
                    counts = np.zeros((len(context[i : i + BLOCK]), shape.leaves))
                    counts[row[lo:hi] - i, leaf[lo:hi]] = k[lo:hi]
                    gradient(sent.value, context[i : i + BLOCK], counts, shape, g)
            at = np.flatnonzero(g.any(1))
            for block in np.unique(at // FEATURE_BLOCK).tolist():
                mine = g[block * FEATURE_BLOCK : (block + 1) * FEATURE_BLOCK].astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mine.tobytes()], pa.binary())], ["block", "g"])

        g = np.zeros_like(weights)
        for row in parts.mapInArrow(grad, "block int, g binary").groupBy("block").applyInArrow(_add_up, "block int, g binary").collect():
            mine = np.frombuffer(row["g"], "<f4").reshape(-1, g.shape[1])
            g[row["block"] * FEATURE_BLOCK :][: len(mine)] = mine
        sent.destroy()
        g /= n
        g -= l2 * weights
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * np.square(g, out=g)
        np.sqrt(np.divide(v, 1 - 0.99**epoch, out=g), out=g)
        g += 1e-7
        weights += np.divide(m, g, out=g) * (rate / (1 - 0.9**epoch))
    return weights


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", epochs: int = 24, rate: float = 0.15, l2: float = 1e-6, step: int | None = None, scale: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (the
    model's); both are log10 probabilities of the whole text.

    The model starts at `scale` times 256 leaves (160 of them for one token each), 16 classes, contexts of
    128 x 32 codes and 512 trigram buckets, up to `step` (STEP) distinct training tokens; leaves, codes and
    buckets double with each eightfold of these, so contexts x leaves grow in proportion to the tokens."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // BUCKET_BYTES)
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 << 20))

    spark_schema = f"chunk long, names array<{kind}>, lengths array<int>, train array<boolean>, tokens binary, met array<int>, sizes array<int>, width int, body binary"
    name_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("chunk", pa.int64()), ("names", pa.list_(name_type)), ("lengths", pa.list_(pa.int32())), ("train", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("met", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("width", pa.int32()), ("body", pa.binary())])
    together = F.shiftright("chunk", 16).alias("together")
    chunks = rows.withColumn("train", ~held_out).mapInArrow(_chunked(buckets, schema), spark_schema)
    chunks = bucketed_table(chunks.select("*", together), "lm_chunks", "together", wide)
    asked = chunks.select("chunk", "lengths", "train", "tokens", "met", "sizes", "width", "body").mapInArrow(_requests, "bucket int, chunk long, tokens binary, body binary")

    most = Shape.of(size, step, scale)  # there are fewer tokens than bytes
    answered = asked.repartition(wide, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _answers(batches, most), "kind int, chunk long, bucket int, counts binary, token binary, n long, v long")
    answered = stage_table(answered, "lm_counts")
    v_all = answered.where("kind = 2").agg(F.sum("v")).first()[0] or 0
    shape = Shape.of(v_all, step, scale)
    top = [(bytes(r["token"]), r["n"]) for r in answered.where("kind = 1").orderBy(F.col("n").desc(), "token").limit(shape.own).select("token", "n").collect()]
    ends = dict(top).get(END)
    if ends is None and top:  # the end is a token as any other, but always has a leaf
        found = answered.where((F.col("kind") == 1) & (F.col("token") == F.lit(bytearray(END)))).select("n").first()
        top = [*top[: shape.own - 1], (END, found["n"] if found else 0)]
    own_n = np.zeros(shape.leaves, np.int64)
    own_v = np.zeros(shape.leaves, np.int64)
    for r in answered.where("kind = 2").groupBy((F.col("chunk") % shape.shared).alias("k")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        own_n[shape.own + r["k"]], own_v[shape.own + r["k"]] = r["n"], r["v"]
    n_all = int(own_n.sum())
    for i, (t, n) in enumerate(top):
        own_n[i] = n
        own_n[shape.own + ending(t) % shape.shared] -= n
        own_v[shape.own + ending(t) % shape.shared] -= n > 0
    own = [t for t, _ in top]

    parts = 4 * STAT_PARTS * shape.scale

    def count(batches):
        codes, held, size = Codes(own, shape), [], 0

        def flush():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            part = features(code // shape.leaves, shape)[:, 3] % parts
            for p in np.unique(part):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_pack(code[part == p], n[part == p])], pa.binary())], ["part", "body"])

        for batch in batches:
            for lengths, train, tokens, width, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                leaf, h1, h2 = codes.of(tokens.split(b"\n"))
                flat, lengths = np.frombuffer(body, f"<u{width}").astype(np.int64), np.array(lengths, np.int64)
                use = np.repeat(np.array(train, bool), lengths)
                held.append((_contexts(flat, lengths, h1, h2, shape) * shape.leaves + leaf[flat])[use])
                size += len(held[-1])
                if size >= POSITIONS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    counted = chunks.select("lengths", "train", "tokens", "width", "body").mapInArrow(count, "part int, body binary")
    stats = stage_table(counted.repartition(STAT_PARTS * shape.scale, "part").sortWithinPartitions("part").mapInArrow(_merge, "part int, body binary"), "lm_statistics")

    def by_leaf(batches):
        for body in (x for b in batches for x in b.column(0).to_pylist()):
            code, n = _unpack(body)
            yield pa.RecordBatch.from_arrays([pa.array([np.bincount(code % shape.leaves, weights=n, minlength=shape.leaves).tobytes()], pa.binary())], ["n"])

    totals = np.zeros(shape.leaves)
    for r in stats.select("body").mapInArrow(by_leaf, "n binary").collect():
        totals += np.frombuffer(bytes(r["n"]), np.float64)
    sent = spark.sparkContext.broadcast(_train(stats, totals, epochs, rate, l2, shape))

    def norms(batches):
        for batch in batches:
            context = batch.column(0).to_numpy()
            for i in range(0, len(context), BLOCK):
                c, leaf = _scores(sent.value, context[i : i + BLOCK], shape)
                z = _norm(leaf)[:, :, 0] + _norm(c)
                yield pa.RecordBatch.from_arrays([pa.array(context[i : i + BLOCK]), pa.array([x.tobytes() for x in z.astype(np.float32)], pa.binary())], ["context", "z"])

    # of each context and class, what the scores of a class and its leaf exceed their log probability by
    normal = np.zeros((shape.contexts, shape.classes), np.float32)
    for r in spark.range(0, shape.contexts, 1, STAT_PARTS).mapInArrow(norms, "context long, z binary").toLocalIterator():
        normal[r["context"]] = np.frombuffer(bytes(r["z"]), np.float32)
    normal = spark.sparkContext.broadcast(normal)
    per_class = shape.leaves // shape.classes

    codes = Codes(own, shape)
    base = np.log10(float(n_all + v_all + 1))
    inside = np.log10(own_n + own_v + 1.0)

    def finish(whole, replies):
        answers, out = {}, []
        for chunk, _, counts in sorted(zip(*(replies[k].to_pylist() for k in ("chunk", "bucket", "counts")))):
            answers.setdefault(chunk, []).append(_of_planes(counts))
        for chunk, names, lengths, tokens, width, body in zip(*(whole[k].to_pylist() for k in ("chunk", "names", "lengths", "tokens", "width", "body"))):
            c = np.concatenate(answers.pop(chunk))  # tokens lie by bucket
            leaf, h1, h2 = codes.of(tokens.split(b"\n"))
            flat, lengths = np.frombuffer(body, f"<u{width}").astype(np.int64), np.array(lengths, np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            known = np.log10(c + 1.0)
            in_leaf = np.where(leaf < len(own), 0.0, known - inside[leaf])
            context, to = _contexts(flat, lengths, h1, h2, shape), leaf[flat]
            group, w = to // per_class, sent.value
            f = features(context, shape)
            lp = sum(w[f[:, k], group] + w[f[:, k], shape.classes + to] for k in range(f.shape[1])) - normal.value[context, group]
            lp = lp / np.log(10) + in_leaf[flat]
            columns = [pa.array(names, name_type), pa.array(lengths), pa.array(np.add.reduceat((c > 0)[flat].astype(np.int64), starts)), pa.array(np.add.reduceat(known[flat], starts) - lengths * base), pa.array(np.add.reduceat(lp, starts))]
            out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out)

    replies = answered.where("kind = 0").select("chunk", "bucket", "counts", together)
    whole = chunks.select("together", "chunk", "names", "lengths", "tokens", "width", "body")
    out = whole.groupBy("together").cogroup(replies.groupBy("together")).applyInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").alias(doc_id), held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
