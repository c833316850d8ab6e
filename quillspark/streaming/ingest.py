"""Streaming ingestion: files or rows that arrive are parsed and rendered as they come.

Every transformation here is stateless, so no watermark is needed; a query that has run to the end of
what was there leaves a table in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans import extract
from ..sources import readers


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """doc_id, path, length, content of files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(readers.RAW).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return readers.with_id(files)


def extract_stream(spark: SparkSession, folder: str, mode: str = "plain", images: bool = False) -> DataFrame:
    """extract() over a folder's files as they arrive; start it with writeStream."""
    return extract.extract_from(file_stream(spark, folder), mode, images)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a streaming query over what is there now and reads its output."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """A stateless transformation of a table of Parquet files, a folder or one file, run to the end of what is there."""
    files = spark.read.parquet(f"{folder}/{name}").inputFiles()
    reader = spark.readStream.schema(schema)
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a stream's source is a folder
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = reader.parquet(f"{folder}/{name}")
    return run_to_end(transform(rows), label)
