"""A session with what the engine relies on; on a cluster, pass its own settings in `more`."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "breakwater", more: dict[str, str] | None = None) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | (more or {})).getOrCreate()
