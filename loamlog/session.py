"""Session settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loamlog", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys write dots as two underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
