"""Alignments and contigs from SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar
from .lines import numbered_lines


def read_sam(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """contigs (schema.CONTIGS) and alignments (schema.ALIGNMENTS). Lines with fewer than eleven fields are dropped; ord is the line in the file, or in
    all files, one after the other in the order of their names. A contig that several files name is one, at its first place."""
    lines = numbered_lines(spark, path).withColumnRenamed("line", "ord")
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1), F.lit(""))
    heads = lines.where(F.startswith("value", F.lit("@SQ\t"))).select("ord", tag("SN").alias("chrom"), tag("LN").cast("bigint").alias("length")).where("chrom IS NOT NULL AND length IS NOT NULL").groupBy("chrom").agg(F.min("ord").alias("ord"), F.min_by("length", "ord").alias("length"))
    smaller = heads.groupBy().agg(F.array_sort(F.collect_list("ord")).alias("all"))  # one number a contig
    contigs = heads.crossJoin(F.broadcast(smaller)).select((F.array_position("all", F.col("ord")) - 1).cast("int").alias("ord"), "chrom", "length")
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("@"))).withColumn("f", f).where(F.size("f") >= 11)
    code, seq = F.col("f")[5], F.col("f")[9]
    start = F.col("f")[3].try_cast("bigint") - 1
    size = F.when(seq == "*", cigar.query_length(code)).otherwise(F.length(seq).cast("bigint"))
    alignments = rows.select("ord", F.col("f")[0].alias("read_name"), F.col("f")[1].try_cast("int").alias("flag"), F.col("f")[2].alias("chrom"), start.alias("start"), (start + cigar.reference_length(code)).alias("stop"), F.col("f")[4].try_cast("int").alias("mapq"), code.alias("cigar"), F.nullif(F.regexp_extract("value", r"\tSA:Z:([^\t]*)", 1), F.lit("")).alias("sa"), size.cast("int").alias("query_length"))
    return contigs, alignments
