"""A Spark session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "veriloom", **conf: str) -> SparkSession:
    """UTC and adaptive execution; conf adds settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
