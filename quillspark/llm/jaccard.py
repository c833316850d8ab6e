"""Exact n-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct word shingles.  Shingles are hashed into groups, twice:

1. Blocking.  Sets that link differ in at most d shingles, where d follows from their sizes.  Hashed
   into more than d groups, they have a group with equal content; so documents of one size class
   that share no group's content can't link.  A group of fewer than two shingles isn't used unless
   a document has too few others for that proof, in which case all its groups are.
2. R-trees.  In each block, counts by hash group are points of an R-tree; boxes of nearby points are
   compared by the sum over coordinates of the smaller upper bound, which no overlap exceeds, then
   points by the sum of their minima.  Documents connected by pairs that remain form clusters.
3. Verification.  Clusters are dealt into tiles of bounded size.  For each two tiles of a cluster, finer
   counts go through the same R-tree join, and pairs that remain are compared by their sets.

Pairs go out of a block, and links out of a tile pair, as a spanning forest, whose connected components
are those of all of them.  Shingles and whole sets are told apart by 64-bit hashes.

Defined results: no words, or null text: n_shingles 0, linked with nothing, component_id its own
doc_id; fewer words than `width`: the whole sequence is the one shingle; a null doc_id links as any
other but is never a component's smallest; rows with equal ids are separate documents; an empty
table gives no rows; long texts are read whole; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mix, slices, stage_table, windows, with_columns, word_hashes
from .graph import components

_U = np.uint64
TILE = 64  # documents of a cluster that are compared as one tile
LEAF = 16  # points in a leaf of an R-tree
BLOCK = 512  # members of a block that are compared at once; larger blocks are cut into tiles of half as many


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    n = len(offsets) - 1
    hashes, docs = word_hashes(data, offsets, lower=True)
    keys, start = windows(hashes, docs, width)
    at = np.searchsorted(docs[start], np.arange(n + 1))
    words = np.searchsorted(docs, np.arange(n + 1))
    out = []
    for i in range(n):
        if at[i] < at[i + 1]:
            out.append(np.unique(keys[at[i] : at[i + 1]]))
        elif words[i] < words[i + 1]:
            few = hashes[words[i] : words[i + 1]]
            with np.errstate(over="ignore"):
                total = sum((mix(few[k : k + 1] + _U(k + 1) * _U(0xA24BAED4963EE407)) * _U(2 * k + 5) for k in range(len(few))), np.zeros(1, _U))
            out.append(mix(total + _U(len(few))))
        else:
            out.append(np.zeros(0, _U))
    return out


def set_key(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.upper = [1]
        while self.most(self.upper[-1]) == 0:
            self.upper.append(self.upper[-1] + 1)
        self.upper = self.upper[-2:-1] or [0]  # sets up to here link only if equal

    def most(self, size: int) -> int:
        """Most shingles in which two linked sets of at most `size` can differ."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def most_from(self, size):
        """Most shingles in which a set of this size can differ from any that it links with."""
        return size * (self.den - self.num) // self.num

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def classes(self, most: int) -> np.ndarray:
        """Upper size bounds of the size classes; a linked set is at most one class further."""
        ratio = max(1.6, 1.2 * self.den / self.num)
        while self.upper[-1] < most:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] * ratio)))
        return np.array(self.upper)


def signatures(sets: list[np.ndarray], t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for every group content that may be shared with a linked set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    most = int(sizes.max(initial=0))
    upper = t.classes(2 * most + 2)
    own = np.searchsorted(upper, sizes)
    next_too = t.den * sizes >= t.num * (upper[own] + 1)
    out_sig, out_set = [], []
    for step in (0, 1):
        use = np.flatnonzero((sizes > 0) & ((own > 0) if step == 0 else next_too))
        if not len(use):
            continue
        k = own[use] + step
        d = np.array([t.most(int(u)) for u in upper[k]])
        m = d + 3 + d // 10
        base = np.concatenate([[0], np.cumsum(m)])
        n = sizes[use]
        shingles = np.concatenate([sets[i] for i in use])
        of = np.repeat(np.arange(len(use)), n)
        with np.errstate(over="ignore"):
            salted = mix(shingles + _U(0x8CB92BA72F3D8DD7) * (k[of].astype(_U) + _U(1)))
            at = base[of] + ((salted >> _U(33)) % m[of].astype(_U)).astype(np.int64)
            total = np.zeros(base[-1], _U)
            np.add.at(total, at, mix(salted))
            count = np.bincount(at, minlength=base[-1])
            group_of = np.repeat(np.arange(len(use)), m)
            rank = np.arange(base[-1]) - base[group_of]
            sig = mix(total + mix(k[group_of].astype(_U) * _U(0x9E3779B97F4A7C15) + rank.astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
            strong = count >= 2
            enough = np.bincount(group_of, weights=strong, minlength=len(use)) > np.minimum(d, t.most_from(n))
            weak_sig = mix(sig + _U(0x5851F42D4C957F2D))
        all_groups = ~enough[group_of]
        for s, mask in ((sig, strong), (weak_sig, all_groups)):
            out_sig.append(s[mask])
            out_set.append(use[group_of[mask]])
    if not out_sig:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


class Box:
    """A node of an R-tree: bounds of its points, their sizes, and its children or points."""

    __slots__ = ("top", "least", "most", "children", "points")

    def __init__(self, top, least, most, children, points):
        self.top, self.least, self.most, self.children, self.points = top, least, most, children, points


def build_tree(counts: np.ndarray, sizes: np.ndarray) -> Box:
    """Bulk load: points sorted by size, then by where their counts lie, in leaves of LEAF, packed upwards."""
    order = np.lexsort((counts[:, : counts.shape[1] // 2].sum(1), sizes))
    level = [Box(counts[p].max(0), int(sizes[p].min()), int(sizes[p].max()), None, p) for p in (order[i : i + LEAF] for i in range(0, len(order), LEAF))]
    while len(level) > 1:
        level = [Box(np.max([c.top for c in g], 0), min(c.least for c in g), max(c.most for c in g), g, None) for g in (level[i : i + LEAF] for i in range(0, len(level), LEAF))]
    return level[0]


def tree_pairs(a: Box, b: Box, t: Threshold):
    """Leaves of either tree that the bounds don't rule out."""
    small, large = max(a.least, b.least), min(a.most, b.most)
    if t.num * small > t.den * large and (t.num * a.least > t.den * b.most or t.num * b.least > t.den * a.most):
        return
    bound = int(np.minimum(a.top, b.top).sum())
    if not t.linked(min(bound, a.most, b.most), a.least, b.least):
        return
    if a.points is not None and b.points is not None:
        yield a.points, b.points
    elif b.points is not None or (a.points is None and a.most >= b.most):
        for c in a.children:
            yield from tree_pairs(c, b, t)
    else:
        for c in b.children:
            yield from tree_pairs(a, c, t)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def dimensions(size: int) -> int:
    """Groups of a document's count vector in the blocks: a power of two, at least an eighth of its shingles,
    with room for the next size class."""
    return 1 << max(5, (size // 4).bit_length())


def count_vector(shingles: np.ndarray, dims: int) -> np.ndarray:
    return np.bincount((shingles >> _U(7)).astype(np.int64) & (dims - 1), minlength=dims)


def fold(counts: np.ndarray, dims: int) -> np.ndarray:
    """A count vector over fewer groups."""
    return counts.reshape(-1, dims).sum(0)


def pairs_within_bound(counts: np.ndarray, sizes: np.ndarray, n_left: int | None, t: Threshold):
    """(a, b, most shingles they can share) for pairs that the R-trees' bounds leave: of points up to
    n_left and after, or of all where it is None."""
    split = n_left is not None
    n = n_left if split else len(sizes)
    trees = [build_tree(counts[:n], sizes[:n])]
    if split:
        trees.append(build_tree(counts[n:], sizes[n:]))
    for p, q in tree_pairs(trees[0], trees[-1], t):
        q = q + n if split else q
        overlap = np.zeros((len(p), len(q)), np.int64)
        for level in range(1, int(min(counts[p].max(), counts[q].max())) + 1):  # sums of minima, level by level
            x, y = (counts[p] >= level).astype(np.float32), (counts[q] >= level).astype(np.float32)
            overlap += (x @ y.T).astype(np.int64)
        union = sizes[p][:, None] + sizes[q][None, :] - overlap
        for i, j in np.argwhere(t.den * overlap >= t.num * union):
            if split or p[i] < q[j]:
                yield int(p[i]), int(q[j])


def join_tiles(left: list[np.ndarray], right: list[np.ndarray] | None, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles, or within one; indexes run on from left to right."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    dims = 1 << max(5, min(10, int(sizes.max()).bit_length() + 1))
    counts = np.stack([count_vector(s, dims) for s in sets])
    forest, out = Forest(len(sets)), []
    for a, b in pairs_within_bound(counts, sizes, len(left) if right is not None else None, t):
        if forest.root(a) != forest.root(b):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if t.linked(both, len(sets[a]), len(sets[b])):
                forest.join(a, b)
                out.append((a, b))
    return out


def block_forest(left: list[np.ndarray], right: list[np.ndarray] | None, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of count vectors that can be linked."""
    vectors = left + (right or [])
    sizes = np.array([v.sum() for v in vectors], np.int64)
    dims = min(len(v) for v in vectors)
    counts = np.stack([fold(v, dims) for v in vectors])
    if len(vectors) == 2:
        both = int(np.minimum(counts[0], counts[1]).sum())
        return [(0, 1)] if t.linked(both, int(sizes[0]), int(sizes[1])) else []
    forest = Forest(len(vectors))
    return [(a, b) for a, b in pairs_within_bound(counts, sizes, len(left) if right is not None else None, t) if forest.join(a, b)]


def _candidates(docs: DataFrame, vectors: DataFrame, width: int, t: Threshold, shingles: int) -> DataFrame:
    """(a, b): keys of different sets that share a block and pass its bounds, as a forest for each block."""
    buckets = max(256, shingles // 500_000)
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)

    def emit(batches):
        done: set[int] = set()
        held, count = [], 0

        def flush():
            pairs = np.concatenate(held)
            to = (pairs[:, 0] % _U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            pairs = pairs[order]
            met, heads = np.unique(to[order], return_index=True)  # only buckets that have pairs
            cuts = [*heads.tolist(), len(pairs)]
            return pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array([pairs[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(met))], pa.binary())], ["bucket", "pairs"])

        for _, data, offsets in slices(batches, "text"):
            fresh, keys = [], []
            for s in shingle_sets(data, offsets, width):
                key = set_key(s)
                if key is not None and key not in done:
                    done.add(key)
                    fresh.append(s)
                    keys.append(key)
            if fresh:
                sig, of = signatures(fresh, t)
                held.append(np.stack([sig, np.array(keys, np.int64).view(_U)[of]], 1))
                count += len(sig)
            if count >= 1_000_000:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def by_bucket(batches):
        """The pairs of one bucket after another, from rows sorted by bucket."""
        at, parts = None, []
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != at and parts:
                    yield np.concatenate(parts)
                    parts = []
                at = b
                parts.append(np.frombuffer(batch.column(1)[i].as_py(), _U).reshape(-1, 2))
        if parts:
            yield np.concatenate(parts)

    def collide(batches):
        for pairs in by_bucket(batches):
            key = np.ascontiguousarray(pairs[:, 1]).view(np.int64)
            order = np.lexsort((key, pairs[:, 0]))
            sig, key = pairs[order, 0], key[order]
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])  # copies met in several tasks
            sig, key = sig[fresh], key[fresh]
            head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(head, len(sig)))
            many = np.repeat(size > 1, size)
            sig, key, of = sig[many], key[many], np.repeat(size, size)[many]
            place = np.arange(len(sig)) - np.repeat(np.cumsum(size[size > 1]) - size[size > 1], size[size > 1])
            small = of <= BLOCK
            yield from _member_rows(sig[small], key[small], 0, 0, 0)
            for s in np.unique(sig[~small]):
                at = (sig == s) & ~small
                tile = place[at] // (BLOCK // 2)
                for other in range(int(tile.max()) + 1):
                    yield from _member_rows(sig[at], key[at], np.minimum(tile, other), np.maximum(tile, other), tile)

    def refine(batches):
        done: set[tuple[int, int]] = set()
        for left, right in _groups(batches, lambda v: np.frombuffer(v, "<u2").astype(np.int64)):
            names = [k for k, _ in left + right]
            if len(names) == 2 and (names[0], names[1]) in done:
                continue
            pairs = [(names[a], names[b]) for a, b in block_forest([v for _, v in left], [v for _, v in right] if right else None, t)]
            pairs = [p for p in pairs if p not in done]
            done.update(pairs)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

    dealt = docs.select("text").mapInArrow(emit, "bucket long, pairs binary").repartition(spread, "bucket").sortWithinPartitions("bucket")
    members = stage_table(dealt.mapInArrow(collide, "cluster long, lo int, hi int, tile int, key long"), "block_members")
    points = members.join(vectors, "key").select("cluster", "lo", "hi", "tile", "key", "vector")
    return points.repartition(spread, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "key").mapInArrow(refine, "a long, b long")


def _member_rows(block, key, lo, hi, tile):
    n = len(block)
    for i in range(0, n, 50_000):
        part = slice(i, min(n, i + 50_000))
        columns = [np.broadcast_to(np.asarray(x, np.int32), n)[part].copy() for x in (lo, hi, tile)]
        yield pa.RecordBatch.from_arrays([pa.array(block[part].view(np.int64)), *map(pa.array, columns), pa.array(key[part])], ["cluster", "lo", "hi", "tile", "key"])


def _linked_sets(docs: DataFrame, doc_id: str, text: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of each document, and (key, doc_id, root) of each distinct set: its smallest doc_id
    and the smallest key that it is linked with."""
    t = Threshold(num, den)
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def summarise(batches):
        for rows, data, offsets in slices(batches, "text"):
            sets = shingle_sets(data, offsets, width)
            vectors = pa.array([np.minimum(count_vector(s, dimensions(len(s))), 65535).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())
            yield with_columns(rows, ["doc_id"], n=np.array([len(s) for s in sets], np.int64), key=pa.array([set_key(s) for s in sets], pa.int64()), vector=vectors)

    def rebuild(batches):
        for rows, data, offsets in slices(batches, "text"):
            sets = shingle_sets(data, offsets, width)
            yield with_columns(rows, ["cluster", "tiles", "key"], shingles=pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))

    def compare(batches):
        for left, right in _groups(batches, lambda v: np.frombuffer(v, "<u8")):
            names = [k for k, _ in left + right]
            links = join_tiles([s for _, s in left], [s for _, s in right] if right else None, t)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], ["a", "b"])

    summary = stage_table(docs.mapInArrow(summarise, f"doc_id {kind}, n long, key long, vector binary"), "shingle_counts")
    shingles = summary.agg(F.sum("n")).first()[0] or 0
    first = stage_table(summary.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("vector").alias("vector")), "first_ids")
    clusters = stage_table(components(_candidates(docs, first.select("key", "vector"), width, t, shingles)), "clusters")
    first = first.select("key", "doc_id")
    tiles = stage_table(clusters.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles")), "cluster_sizes")
    wanted = clusters.join(tiles, "root").select(F.col("node").alias("key"), F.col("root").alias("cluster"), "tiles").join(first, "key")
    asked = wanted.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "cluster", "tiles")
    keyed = docs.mapInArrow(_keyed(width, "doc_id", "text", True), f"doc_id {kind}, text string, key long")
    met = keyed.join(asked, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    sets = met.select("text", "cluster", "tiles", "key").mapInArrow(rebuild, "cluster long, tiles long, key long, shingles binary")
    tile = F.pmod(F.xxhash64("key"), F.col("tiles"))
    sides = sets.withColumn("tile", tile).dropDuplicates(["key"]).select("cluster", "tile", "key", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    pairs = sides.select("cluster", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "key", "shingles")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles // 4_000_000)
    links = pairs.repartition(parts, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "key").mapInArrow(compare, "a long, b long")
    root = components(links)
    of_set = first.join(root.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    return summary.select("doc_id", "n", "key"), stage_table(of_set, "set_roots")


def _keyed(width: int, doc_id: str, text: str, once: bool):
    """Appends the set's key to rows with words; with `once`, a doc_id and key that a task has met go no further."""

    def run(batches):
        done: set[tuple] = set()
        for rows, data, offsets in slices(batches, text):
            keys = [set_key(s) for s in shingle_sets(data, offsets, width)]
            use = [k is not None for k in keys]
            if once:
                for i, pair in enumerate(zip(rows.column(rows.schema.get_field_index(doc_id)).to_pylist(), keys)):
                    use[i] = use[i] and pair not in done
                    done.add(pair)
            columns = [*rows.columns, pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "key"]).filter(pa.array(use, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: documents whose shingle sets have a Jaccard similarity of at
    least num / den are linked, and linked ones share the smallest doc_id reachable."""
    summary, of_set = _linked_sets(docs, doc_id, text, width, num, den)
    smallest = stage_table(of_set.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest_ids")
    answer = stage_table(of_set.join(smallest, "root").select("key", "component_id"), "set_components")
    out = summary.join(answer, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumnRenamed("doc_id", doc_id)


def _groups(batches, decode):
    """From rows sorted by (cluster, lo, hi): the two sides of each tile pair, as lists of (key, decoded value)."""
    at, left, right = None, [], []
    for batch in batches:
        c, lo, hi, tile, key, value = (batch.column(i).to_pylist() for i in range(6))
        for i in range(len(c)):
            if at != (c[i], lo[i], hi[i]):
                if left and (right or (at[1] == at[2] and len(left) > 1)):
                    yield left, right
                at, left, right = (c[i], lo[i], hi[i]), [], []
            (left if tile[i] == lo[i] else right).append((key[i], decode(value[i])))
    if left and (right or (at[1] == at[2] and len(left) > 1)):
        yield left, right


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows that stay when one row of each component does: that with the smallest doc_id, null being the
    largest; of several, that with the smallest key of its set, then the smallest hash of the row.  Rows
    without words all stay, and so do rows with null or equal ids that aren't linked.  All columns are kept."""
    _, of_set = _linked_sets(docs, doc_id, text, width, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s")
    stay = of_set.groupBy("root").agg(first).select(F.col("s.key").alias("k"), F.col("s.doc_id").alias("d"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    kinds = StructType([*rows.schema.fields, StructField("key", LongType())])
    keyed = rows.mapInArrow(_keyed(width, "doc_id", "text", False), kinds)
    found = keyed.join(stay, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    tie = F.xxhash64(*(F.col("row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    one = found.groupBy("key").agg(F.min_by("row", tie).alias("row")).select("row.*")
    wordless = ~F.coalesce(docs[text], F.lit("")).rlike("[^ \\t-\\r]")
    return one.unionByName(docs.where(wordless))
