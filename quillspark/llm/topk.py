"""Exact top-k search by inner product over a pivot-distance index.

With M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and q -> (q, 0) turn the largest inner product
into the smallest distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  Each vector is keyed by its nearest
pivot and its distance to it, and blocks hold the vectors of an annulus around a pivot, sorted by
distance.  A query first searches the block it would lie in, which gives a k-th best score t; by the
triangle inequality only vectors whose distance to a pivot p lies within sqrt(|q|^2 + M^2 - 2 t) of
the query's own can do as well, so of every pivot's annuli just those are read, and within a block
just that range.  Scores are whole numbers, computed exactly.

Query blocks meet index blocks in a join on the pivot, so no vector is broadcast; pivots (at most
`pivots`) are the only rows that reach the driver.  Crowded annuli are dealt into several blocks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part;
shorter vectors are padded with zeros; rows with the query's id are not its candidates; of repeated
ids, a query gets each id once, with its best score; a null id is a candidate, but never a query;
fewer candidates than k give all of them; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage_table

RINGS = 16
SLACK = 1e-6  # relative, for distances in floating point


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null, empty, or holds a null or non-finite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when((F.size(vector) > 0) & ~bad, whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole-number rows: in doubles where no sum reaches 2^53, else in 64-bit integers."""
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


class Space:
    """Pivots and the distances to them in the extended space."""

    def __init__(self, pivots: np.ndarray, most: int, exact: bool):
        self.pivots, self.most, self.exact = pivots, most, exact
        norm = (pivots.astype(np.float64) ** 2).sum(1)
        self.norm, self.extra = norm, np.sqrt(np.maximum(0, most - norm))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = (x.astype(np.float64) ** 2).sum(1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most - norm))
        square = norm[:, None] + self.norm[None, :] - 2.0 * products(x, self.pivots, self.exact) + (extra[:, None] - self.extra[None, :]) ** 2
        return np.sqrt(np.maximum(0, square))


def _best(scores: np.ndarray, ids: list, k: int) -> list[tuple[int, object]]:
    """The k highest (score, id), ties to the smaller id, null last."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= cut)
    else:
        pick = np.arange(len(scores))
    return sorted(((int(scores[i]), ids[i]) for i in pick), key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def top_k(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5, pivots: int = 64, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score.  `vector` is a column of arrays of whole numbers, `is_query` a
    condition on the rows."""
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType
    kind = id_type.simpleString()
    arrow_id = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(id_type)]
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x"), F.coalesce(is_query & F.col(vec_id).isNotNull(), F.lit(False)).alias("asks")).where("x IS NOT NULL")
    rows = stage_table(rows, "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(F.size("x")).alias("dim"), F.max(square).alias("most")).first()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score long"
    if not facts["n"] or not facts["q"]:
        return spark.createDataFrame([], schema)
    n, asked, dim, most = facts["n"], facts["q"], facts["dim"], facts["most"]
    exact = most < 2**52
    chosen = rows.orderBy(F.xxhash64("x"), F.xxhash64("vec_id")).limit(min(pivots, 1 + int(n**0.5))).select("x").collect()
    at = np.zeros((len(chosen), dim), np.int64)
    for i, r in enumerate(chosen):
        at[i, : len(r["x"])] = r["x"]
    space = Space(np.unique(at, axis=0), most, exact)
    n_pivots, width = len(space.pivots), 2 * np.sqrt(most) / RINGS + 1e-9
    block = int(min(4096, max(128, n // 512)))

    def key(batches):
        for b in batches:
            if b.num_rows:
                d = space.distances(_matrix(b.column(1), dim), False)
                near = d.argmin(1)
                dist = d[np.arange(len(d)), near]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32)), pa.array((dist / width).astype(np.int32)), pa.array(dist)], ["vec_id", "x", "asks", "pivot", "ring", "dist"])

    keyed = stage_table(rows.mapInArrow(key, f"vec_id {kind}, x array<long>, asks boolean, pivot int, ring int, dist double"), "keyed_vectors")
    cells = stage_table(keyed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / block).cast("long").alias("parts")), "annuli")
    dealt = keyed.join(cells, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "dist"), "parts"))

    def build(t: pa.Table) -> pa.Table:
        """A block, and its queries with the k-th best score found in it."""
        t = t.combine_chunks().sort_by("dist")
        x, dist, ids = _matrix(t.column("x").combine_chunks(), dim), t.column("dist").to_numpy(), t.column("vec_id").to_pylist()
        asks = np.flatnonzero(t.column("asks").to_numpy(zero_copy_only=False))
        out = [(0, int(t.column("pivot")[0].as_py()), float(dist[0]), float(dist[-1]), ids, dist.tobytes(), x.tobytes(), None)]
        if len(asks):
            s = products(x[asks], x, exact)
            floor = []
            for i, j in enumerate(asks):
                others = np.array([v != ids[j] for v in ids])
                best = _best(s[i][others], [v for v in ids if v != ids[j]], k)
                floor.append(best[-1][0] if len(best) == k and len({v for _, v in best}) == k else np.iinfo(np.int64).min)
            out.append((1, out[0][1], None, None, [ids[j] for j in asks], None, x[asks].tobytes(), np.array(floor, np.int64).tobytes()))
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(arrow_id), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], ty) for i, ty in enumerate(types)], ["kind", "pivot", "lo", "hi", "ids", "dist", "x", "floor"])

    built = dealt.groupBy("pivot", "ring", "part").applyInArrow(build, f"kind int, pivot int, lo double, hi double, ids array<{kind}>, dist binary, x binary, floor binary")
    built = stage_table(built, "annulus_blocks")
    blocks = built.where("kind = 0").select("pivot", "lo", "hi", "ids", "dist", "x")

    # queries: blocks of about query_block from neighbouring pivots, with the range to read around each pivot
    together = max(1, query_block * n_pivots // asked)
    share = max(1, asked // (query_block * max(1, n_pivots // together)))
    some = built.where("kind = 1").select(F.floor(F.col("pivot") / together).alias("g"), F.pmod(F.xxhash64("x"), F.lit(share)).alias("s"), "ids", "x", "floor")

    def gather(t: pa.Table) -> pa.Table:
        ids = [v for x in t.column("ids").to_pylist() for v in x]
        x = np.concatenate([np.frombuffer(b, np.int64) for b in t.column("x").to_pylist()]).reshape(-1, dim)
        floor = np.concatenate([np.frombuffer(b, np.int64) for b in t.column("floor").to_pylist()])
        d = space.distances(x, True)
        reach = _reach(x, floor, most)
        lo, hi = (d - reach[:, None]).min(0), (d + reach[:, None]).max(0)
        p = len(lo)
        return pa.Table.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array(lo), pa.array(hi), pa.array([ids] * p, pa.list_(arrow_id)), pa.array([x.tobytes()] * p, pa.binary()), pa.array([floor.tobytes()] * p, pa.binary())], ["pivot", "qlo", "qhi", "qids", "qx", "floor"])

    queries = some.groupBy("g", "s").applyInArrow(gather, f"pivot int, qlo double, qhi double, qids array<{kind}>, qx binary, floor binary")
    queries = stage_table(queries, "query_blocks")
    # a file of blocks repeats its vectors for each pivot and packs well, so its size would pass for small enough to broadcast
    met = queries.hint("merge").join(blocks.hint("merge"), (queries["pivot"] == blocks["pivot"]) & (queries["qlo"] <= blocks["hi"]) & (queries["qhi"] >= blocks["lo"])).select(queries["pivot"], "qids", "qx", "floor", "ids", "dist", "x")

    def search(batches):
        found: dict[object, list[tuple[int, object]]] = {}
        for batch in batches:
            for pivot, qids, qx, floor, ids, dist, x in zip(*(batch.column(i).to_pylist() for i in range(7))):
                q, x, dist, floor = np.frombuffer(qx, np.int64).reshape(-1, dim), np.frombuffer(x, np.int64).reshape(-1, dim), np.frombuffer(dist), np.frombuffer(floor, np.int64)
                d, reach = space.distances(q, True)[:, pivot], _reach(q, floor, most)
                lo, hi = np.searchsorted(dist, d - reach, "left"), np.searchsorted(dist, d + reach, "right")
                use = np.flatnonzero(hi > lo)
                if not len(use):
                    continue
                first, last = int(lo[use].min()), int(hi[use].max())
                s = products(q[use], x[first:last], exact)
                names = ids[first:last]
                for i, j in enumerate(use):
                    have = found.get(qids[j], [])
                    least = max(int(floor[j]), have[-1][0] if len(have) == k else int(floor[j]))
                    good = np.flatnonzero(s[i] >= least)
                    new = [(int(s[i][g]), names[g]) for g in good if names[g] != qids[j]]
                    if new:
                        best: dict[object, int] = {}
                        for score, v in have + new:
                            best[v] = max(score, best.get(v, score))
                        found[qids[j]] = sorted(((b, v) for v, b in best.items()), key=lambda y: (-y[0], y[1] is None, y[1] if y[1] is not None else 0))[:k]
        out = [(qid, v, score) for qid, best in found.items() for score, v in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], arrow_id), pa.array([o[1] for o in out], arrow_id), pa.array([o[2] for o in out], pa.int64())], ["query_id", "vec_id", "score"])

    each = met.mapInArrow(search, f"query_id {kind}, vec_id {kind}, score long")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(q: np.ndarray, floor: np.ndarray, most: float) -> np.ndarray:
    """How far from a query a vector that scores at least `floor` can lie, with room for rounding."""
    norm = (q.astype(np.float64) ** 2).sum(1)
    square = norm + most - 2.0 * floor.astype(np.float64)
    return np.sqrt(np.maximum(0, square)) + SLACK * (1 + np.sqrt(norm + most))
