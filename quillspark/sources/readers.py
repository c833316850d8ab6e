"""Files -> detected formats -> parsed records, one row a file.

Files are read with Spark's binaryFile source.  Size and signature tests are native; looking into a
container, and parsing, is Python over Arrow batches.  A file that can't be parsed gives a row with
`error`, never a failed job."""

from __future__ import annotations

import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import schemas
from ..functions.binary import MAX_BYTES, container
from . import biff, ooxml, pdf
from .cfb import CompoundFile

#: What tells the formats of a container apart, in order.
_ZIP_MARKS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
_OLE_MARKS = (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"))
FORMATS = tuple(schemas.RECORDS)
RAW = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """doc_id, path, length, content of each file; folders are read to any depth."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    # the source pushes a filter on length down, so that the bytes of files beyond the limit are never loaded
    big = files.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return with_id(files.where(F.col("length") <= MAX_BYTES).select("path", "length", "content").unionAll(big))


def with_id(files: DataFrame) -> DataFrame:
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def _inside(kind: str, data: bytes) -> str | None:
    try:
        if kind == "zip":
            import io

            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
            return next((fmt for mark, fmt in _ZIP_MARKS if mark in names), None)
        file = CompoundFile(data)
        return next((fmt for mark, fmt in _OLE_MARKS if file.has(mark)), None)
    except Exception:
        return None


def detect(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds `format` and `error`: formats by signature and container, never by name."""

    def peek(kinds, contents):
        out = [_inside(k, c) if k in ("zip", "ole2") and c is not None else ("pdf" if k == "pdf" else None) for k, c in zip(kinds.to_pylist(), contents.to_pylist())]
        return pa.array(out, pa.string())

    peek_udf = F.arrow_udf(peek, "string")
    size = F.col("length") if "length" in files.columns else F.octet_length(F.col(content)).cast("long")
    too_big = size > MAX_BYTES
    kind = F.when(~too_big, container(content))
    out = files.withColumn("_kind", kind)
    out = out.withColumn("format", F.when(F.col("_kind").isNotNull(), peek_udf(F.col("_kind"), F.col(content))))
    megabytes = F.format_string("%.1f", size / F.lit(1048576.0))
    error = F.when(too_big, F.concat(F.lit("file too large: "), megabytes, F.lit(" MiB"))).when(F.col("format").isNull(), F.lit("unsupported format"))
    return out.withColumn("error", error).drop("_kind")


_READ = {
    "docx": ooxml.read_docx,
    "xlsx": ooxml.read_xlsx,
    "pptx": ooxml.read_pptx,
    "xls": lambda data, images=False: biff.read_xls(data),
    "doc": lambda data, images=False: biff.read_doc(data),
    "pdf": lambda data, images=False: pdf.read_pdf(data),
}


def _fit(value, kind):
    """Plain values -> what Arrow takes for a type: tuples for maps' entries become structs."""
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [_fit(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        if isinstance(value, tuple):
            value = dict(zip(names, value))
        return {n: _fit(value.get(n), kind.field(n).type) for n in names}
    return value


def parse(files: DataFrame, fmt: str, images: bool = False, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """doc_id, record (schemas.RECORDS[fmt]), error, from files of one format."""
    kind = files.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, record {schemas.RECORDS[fmt]}, error string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    read = _READ[fmt]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one document at a time: a record can be large
                record = error = None
                data = batch.column(1)[i].as_py()
                try:
                    if data is None:
                        raise ValueError("no content")
                    record = _fit(read(bytes(data), images=images), arrow.field("record").type)
                except Exception as e:  # any broken file is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([record], arrow.field("record").type), pa.array([error], pa.string())], schema=arrow)

    return files.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)


def parse_all(files: DataFrame, images: bool = False) -> DataFrame:
    """doc_id, path, format, error and one nullable record column a format: all files in one pass.
    `files` come from detect()."""
    records = ", ".join(f"{f} {s}" for f, s in schemas.RECORDS.items())
    schema = f"doc_id bigint, path string, format string, error string, {records}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, path, fmt, error, data = (batch.column(k)[i].as_py() for k in range(5))
                row = {"doc_id": doc_id, "path": path, "format": fmt, "error": error}
                if error is None:
                    try:
                        row[fmt] = _fit(_READ[fmt](bytes(data), images=images), arrow.field(fmt).type)
                    except Exception as e:  # any broken file is a row, not a failed job
                        row["error"] = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    return files.select("doc_id", "path", "format", "error", "content").mapInArrow(run, schema)
