"""Session settings that all plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC times, adaptive plans with skew handling, bounded scan partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(name: str = "barline", **more: str) -> SparkSession:
    """A session with ``SETTINGS`` and ``more`` (underscores for dots)."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
