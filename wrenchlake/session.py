"""Session settings this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "wrenchlake", **more: str) -> SparkSession:
    """A session with the package's settings; ``more`` are further settings, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config(map=CONF | {k.replace("__", "."): v for k, v in more.items()})
    return builder.getOrCreate()
