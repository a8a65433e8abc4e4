"""Benchmark summaries (JSON) and run times (CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import add_csv

SUMMARY = "precision DOUBLE, recall DOUBLE, f1 DOUBLE, `TP-base` BIGINT, TP BIGINT, FP BIGINT, FN BIGINT"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """caller (the folder's name), precision, recall, f1, tp, fp, fn of summary files; what is missing or null is 0."""
    rows = spark.read.schema(SUMMARY).json(path, multiLine=True)
    caller = F.element_at(F.split(F.input_file_name(), "/"), -2)
    zero = lambda *c: F.coalesce(*(F.col(x) for x in c), F.lit(0))
    return rows.select(caller.alias("caller"), zero("precision").alias("precision"), zero("recall").alias("recall"), zero("f1").alias("f1"), zero("`TP-base`", "TP").alias("tp"), zero("FP").alias("fp"), zero("FN").alias("fn"))


def summary_lines(summaries: DataFrame) -> DataFrame:
    """CSV lines caller,precision,recall,f1,tp,fp,fn with three decimals."""
    return summaries.select(F.format_string("%s,%.3f,%.3f,%.3f,%d,%d,%d", "caller", F.col("precision").cast("double"), F.col("recall").cast("double"), F.col("f1").cast("double"), F.col("tp").cast("bigint"), F.col("fp").cast("bigint"), F.col("fn").cast("bigint")).alias("value"))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """The summaries as CSV, with three decimals, added to what is there."""
    share = lambda c: F.format_string("%.3f", F.col(c).cast("double")).alias(c)
    rows = summaries.select("caller", share("precision"), share("recall"), share("f1"), "tp", "fp", "fn")
    add_csv(rows, path, {"caller": "Caller", "precision": "Precision", "recall": "Recall", "f1": "F1", "tp": "TP", "fp": "FP", "fn": "FN"})


def write_runtimes(runtimes: DataFrame, path: str) -> None:
    """stage, seconds, memory_gb as CSV, added to what is there; read_runtimes reads them."""
    add_csv(runtimes, path, {"stage": "Stage", "seconds": "Runtime_seconds", "memory_gb": "Memory_GB"})


def read_runtimes(spark: SparkSession, path: str, callers: dict[str, str]) -> DataFrame:
    """caller, seconds, memory_gb: the last row whose stage contains a caller's word; memory only where it is over 0."""
    rows = spark.read.csv(path, header=True, schema="stage STRING, seconds INT, memory_gb DOUBLE").withColumn("nth", F.monotonically_increasing_id())
    name = F.coalesce(*(F.when(F.contains(F.lower("stage"), F.lit(word)), label) for word, label in callers.items()))
    return rows.withColumn("caller", name).where("caller IS NOT NULL").groupBy("caller").agg(F.max_by("seconds", "nth").alias("seconds"), F.max_by("memory_gb", F.when(F.col("memory_gb") > 0, F.col("nth"))).alias("memory_gb"))
