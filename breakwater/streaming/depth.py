"""Sliding windows over a stream: how many rows of a key each window holds. An extension; batch windows over positions are in operators.depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, key: str, ts: str = "ts", width: str = "1500 seconds", step: str = "900 seconds", late: str = "1 hour") -> DataFrame:
    """start, stop, key, n. Rows later than the watermark are left out; state is one row a key and open window."""
    at = F.col(ts).cast("timestamp")
    marked = stream.withColumn("_ts", at).withWatermark("_ts", late)
    counted = marked.groupBy(F.window("_ts", width, step), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), key, "n")
