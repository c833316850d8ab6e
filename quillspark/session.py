"""A Spark session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """Adaptive execution on, times in UTC; further settings by name, dots written as two underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark
