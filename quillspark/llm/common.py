"""What the operators of this package share: intermediate tables, Arrow slices, word hashes.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), and "lower case"
means A-Z only, so both can be read off the UTF-8 bytes without building Python strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once; one longer document is still handled whole.
SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session may lack the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: it cuts the lineage, and what
    a lost executor had computed is not computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """stage_table with the rows in files by a hash of the key, so that grouping by it deals nothing out again.
    The catalog's entry goes at once; the files stay, as the result is read from them."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    df.write.bucketBy(min(buckets, most), key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, a bijection of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~_SPACE
with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_LOWER_VALUE = _VALUE[_FOLD]
_pow = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        step = np.full(max(n, 2 * len(_pow), 64), _BASE, _U)
        step[0] = 1
        _pow = np.cumprod(step)
    return _pow


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most `size` bytes of text each, or one row.  Null reads as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and the index of its document."""
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1]] = True
    values = _LOWER_VALUE if lower else _VALUE
    hashes, docs, lo = [], [], 0
    while lo < n:
        hi = min(n, lo + SLICE_BYTES)
        while hi < n and IS_WORD[data[hi]] and not opens[hi]:  # never cut a word
            step = data[hi : hi + 4096]
            stop = np.flatnonzero(_SPACE[step] | opens[hi : hi + len(step)])
            hi += int(stop[0]) if len(stop) else len(step)
        part = data[lo:hi]
        inside = IS_WORD[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | opens[lo + 1 : hi]
        at = np.flatnonzero(inside)
        if len(at):
            heads = np.flatnonzero(first[at])
            lengths = np.diff(np.append(heads, len(at)))
            rank = np.arange(len(at)) - np.repeat(heads, lengths)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(values[part[at]] * _powers(int(lengths.max()))[rank], heads)
                hashes.append(mix(sums + lengths.astype(_U) * _U(0xD6E8FEB86659FD93)))
            docs.append(np.searchsorted(offsets[1:], at[heads] + lo, side="right"))
        lo = hi
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def windows(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words that lies in one document, and its first word's index."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, _U)
        for k in range(width):
            total += mix(hashes[k : k + n] + _U(0x2545F4914F6CDD1D) * _U(k + 1)) * _U(2 * k + 3)
    start = np.flatnonzero(docs[:n] == docs[width - 1 :])
    return mix(total[start]), start


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document the mask marks."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def with_columns(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The batch's `keep` columns and new ones."""
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays([*arrays, *(c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values())], [*keep, *columns])
