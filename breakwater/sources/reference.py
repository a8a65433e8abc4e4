"""Reference sequences and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines

LINES = 100_000  # lines whose bases are added up in one task


def _placed(lines: DataFrame) -> DataFrame:
    """chrom, at, seq of each line of bases: where it begins in its sequence. A bin of lines is summed up in one task; what a bin needs from those
    before it (bases so far, the last header) comes from one row a bin."""
    head = F.startswith("value", F.lit(">"))
    seq = F.upper(F.regexp_replace("value", r"\s+", ""))
    rows = lines.select("line", F.floor(F.col("line") / LINES).cast("bigint").alias("bin"), F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(~head, seq).alias("seq"))
    size = F.coalesce(F.octet_length("seq"), F.lit(0)).cast("bigint")
    inside = Window.partitionBy("bin").orderBy("line")
    rows = rows.withColumn("upto", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mark = lambda base: F.when(F.col("name").isNotNull(), F.struct(F.col("line"), "name", (F.col("upto") + base).alias("upto")))
    rows = rows.withColumn("here", F.last(mark(0), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    bins = rows.groupBy("bin").agg(F.sum(size).alias("size"), F.max("here").alias("last"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    bins = bins.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    carried = F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("last.upto") + F.col("base")).alias("upto")))
    bins = bins.withColumn("carried", F.last(carried, ignorenulls=True).over(before)).select("bin", "base", "carried")
    known = rows.join(bins, "bin").withColumn("head", F.coalesce(F.when(F.col("here").isNotNull(), F.struct(F.col("here.name").alias("name"), (F.col("here.upto") + F.col("base")).alias("upto"))), "carried"))
    return known.where("seq <> '' AND head.name <> ''").select(F.col("head.name").alias("chrom"), (F.col("base") + F.col("upto") - F.col("head.upto")).alias("at"), "seq")


def _joined(pieces: DataFrame, keys: list[str], at: str = "at", seq: str = "seq") -> DataFrame:
    """Pieces of a chunk or region put together in order: at most its length."""
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, seq))), lambda x: x[seq]), "").alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str], chunk: int = 10_000, overlap: int = 200) -> DataFrame:
    """schema.CHUNKS: upper-case pieces of every sequence, each with the first bases of the next. Every line finds its chunks on its own, so no row holds
    a sequence and the work grows with its length. Lines before the first header are dropped."""
    lines = _placed(numbered_lines(spark, path))
    end = F.col("at") + F.octet_length("seq")
    touched = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - overlap) / chunk)), F.floor((end - 1) / chunk)).cast("array<bigint>")
    rows = lines.withColumn("_k", F.explode(touched)).withColumn("chunk_start", F.col("_k") * chunk)
    first, last = F.greatest("at", "chunk_start"), F.least(end, F.col("chunk_start") + chunk + overlap)
    part = F.substring(F.col("seq").cast("binary"), (first - F.col("at") + 1).cast("int"), (last - first).cast("int")).cast("string")  # of bytes: found at once also in a long line
    return _joined(rows.where(first < last).select("chrom", "chunk_start", first.alias("at"), part.alias("seq")), ["chrom", "chunk_start"])


def fetch(regions: DataFrame, chunks: DataFrame, chunk: int = 10_000, ids: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """regions (ids, chrom, start, stop: half-open, 0-based) with seq, their bases. A region finds its chunks by their numbers; what lies beyond the sequence
    has none, and an unknown sequence, a null bound or an empty region gives the empty text. Equal ids must have equal regions."""
    of = lambda x: F.floor(x / chunk).cast("bigint")
    start = F.greatest(F.col("start"), F.lit(0)).cast("bigint")
    asked = regions.where(F.col("start").isNotNull() & (start < F.col("stop"))).select(*ids, "chrom", start.alias("_from"), F.col("stop").alias("_to")).distinct()
    asked = asked.withColumn("_k", F.explode(F.sequence(of(F.col("_from")), of(F.col("_to") - 1)))).withColumn("chunk_start", F.col("_k") * chunk)
    met = asked.join(chunks, ["chrom", "chunk_start"])
    first, last = F.greatest("_from", "chunk_start"), F.least("_to", F.col("chunk_start") + chunk)
    part = F.substring("seq", (first - F.col("chunk_start") + 1).cast("int"), (last - first).cast("int"))
    found = _joined(met.select(*ids, "chunk_start", part.alias("seq")), list(ids), "chunk_start")
    return regions.join(found, list(ids), "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """schema.REPEATS: at least three fields; a missing fourth is `tandem`; comments and lines without numbers are dropped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).withColumn("f", f).where(F.size("f") >= 3)
    out = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("bigint").alias("start"), F.trim(F.col("f")[2]).try_cast("bigint").alias("stop"), F.coalesce(F.get("f", F.lit(3)), F.lit("tandem")).alias("info"))
    return out.where("start IS NOT NULL AND stop IS NOT NULL")


def wrapped(sequences: DataFrame, width: int = 80) -> DataFrame:
    """FASTA lines (value) of chrom, seq."""
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"))
    return sequences.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), body).alias("value"))
