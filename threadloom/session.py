"""The Spark session that the command line and tests use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "threadloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds or replaces settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
