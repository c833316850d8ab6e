"""Spark SQL surface: a data source of documents, and the converters as SQL functions.

    register(spark)
    spark.read.format("documents").load("/folder")
    SELECT document_format(content), document_text(content) FROM ...
    SELECT t.* FROM files, LATERAL document_cells(content) t
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import _READ, _inside

_MAGIC = ((bytes.fromhex("D0CF11E0A1B11AE1"), "ole2"), (b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"))


def format_of(data: bytes) -> str | None:
    kind = next((k for magic, k in _MAGIC if data.startswith(magic)), None)
    return "pdf" if kind == "pdf" else _inside(kind, data) if kind else None


def raw_record(data: bytes) -> tuple[str, dict]:
    fmt = format_of(data)
    if fmt is None:
        raise ValueError("unsupported format")
    return fmt, _READ[fmt](data)


def raw_text(fmt: str, record: dict) -> list[str]:
    """The text pieces of a record in order, without markup or lookups: for search, not for reading."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k in ("text", "raw", "paragraphs", "pages", "sst", "shared") and v is not None:
                    out.extend(v if isinstance(v, list) else [v])
                elif k in ("blocks", "runs", "rows", "slides", "shapes", "parts", "sheets", "cells"):
                    walk(v)
        elif isinstance(x, (list, tuple)):
            for y in x:
                walk(y)

    walk(record)
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class DocumentReader(DataSourceReader):
    """One partition a file of a folder that all executors can open; use readers.read_files() for remote stores."""

    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("load() needs a path")

    def partitions(self):
        root = self.path.removeprefix("file://")
        files = [root] if os.path.isfile(root) else [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
        return [_File(p) for p in sorted(files)]

    def read(self, partition):
        fmt = text = error = None
        try:
            with open(partition.path, "rb") as f:
                fmt, record = raw_record(f.read())
            text = "\n".join(raw_text(fmt, record))
        except Exception as e:  # any broken file is a row, not a failed job
            error = f"{type(e).__name__}: {e}"[:500]
        yield (partition.path, fmt, text, error)


class DocumentSource(DataSource):
    """format("documents"): path, format, text, error."""

    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        return "path string, format string, text string, error string"

    def reader(self, schema):
        return DocumentReader(self.options)


class DocumentCells:
    """UDTF: the raw cells of a spreadsheet's sheets."""

    def eval(self, content: bytes):
        try:
            fmt, record = raw_record(bytes(content))
        except Exception:
            return
        if fmt == "xlsx":
            for part in record["parts"]:
                for i, row in enumerate(part["rows"]):
                    for c in row["cells"]:
                        yield part["path"], i, c["col"], c["raw"] if c["type"] != "s" else _get(record["shared"], c["raw"])
        elif fmt == "xls":
            for s in record["sheets"]:
                for i, row in enumerate(s["rows"]):
                    for c in row:
                        value = c["text"] if c["kind"] == "text" else record["sst"][c["sst"]] if c["kind"] == "sst" and c["sst"] < len(record["sst"]) else None if c["num"] is None else repr(c["num"])
                        yield s["name"], i, c["col"], value


def _get(strings: list[str], index: str | None) -> str | None:
    try:
        return strings[int(index)]
    except (TypeError, ValueError, IndexError):
        return None


def register(spark: SparkSession) -> None:
    """Registers the data source, document_format(), document_text() and document_cells()."""
    spark.dataSource.register(DocumentSource)

    @F.pandas_udf("string")
    def document_format(content: pd.Series) -> pd.Series:
        return content.map(lambda b: format_of(bytes(b)) if b is not None else None)

    @F.pandas_udf("string")
    def document_text(content: pd.Series) -> pd.Series:
        def one(b):
            try:
                return "\n".join(raw_text(*raw_record(bytes(b)))) if b is not None else None
            except Exception:
                return None

        return content.map(one)

    spark.udf.register("document_format", document_format)
    spark.udf.register("document_text", document_text)
    spark.udtf.register("document_cells", F.udtf(DocumentCells, returnType="sheet string, row int, col int, value string"))
