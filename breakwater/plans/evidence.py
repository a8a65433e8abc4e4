"""Evidence of structural variants from alignments. Every producer returns the columns of schema.EVIDENCE.

alignments: schema.ALIGNMENTS. Unmapped and secondary alignments give nothing; nulls in a field that a rule reads make the rule not hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import cigar, supplementary
from ..operators import depth
from ..params import Params

FAR_COPY, FAR_SEGMENT, SHORT_GAP = 50_000, 100_000, 5_000


def _columns(given: dict[str, Column], step: int) -> list[Column]:
    """All evidence columns; those not given are null. step tells producers apart in the order of arrival."""
    kinds = dict(x.split(" ", 1) for x in schema.EVIDENCE.split(", "))
    given = {"interspersed": F.lit(False)} | given | {"step": F.lit(step)}
    return [given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in schema.EVIDENCE_NAMES]


def _filled(df: DataFrame, step: int) -> DataFrame:
    return df.select(*_columns({n: F.col(n) for n in df.columns}, step))


def usable(alignments: DataFrame) -> DataFrame:
    """Mapped alignments that are not secondary, with `primary` and `strand`."""
    flag = F.col("flag")
    kept = alignments.where((flag.bitwiseAND(4) == 0) & (flag.bitwiseAND(256) == 0))
    return kept.withColumn("primary", flag.bitwiseAND(2048) == 0).withColumn("strand", F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+"))


def _named(reads: DataFrame) -> DataFrame:
    """Alignments that a name joins to a read: those without one (null or *) are each a read of their own, and no pairs of them."""
    return reads.where(F.col("read_name").isNotNull() & (F.col("read_name") != "*"))


def from_cigar(reads: DataFrame, p: Params) -> DataFrame:
    rows = reads.where(F.col("primary") & (F.col("mapq") >= p.min_mapq)).withColumn("e", F.explode(cigar.events(F.col("cigar"), F.col("start"), p.min_sv_size, p.min_del_size)))
    kind = F.when(F.col("e.op") == "I", "INS").otherwise("DEL")
    stop = F.col("e.at") + F.when(F.col("e.op") == "D", F.col("e.n")).otherwise(0)
    return _filled(rows.select("chrom", "read_name", "mapq", "ord", kind.alias("sv_type"), F.concat(F.lit("CIGAR_"), kind).alias("ev_type"), F.col("e.at").alias("start"), stop.alias("stop"), F.col("e.n").alias("size")), 1)


def from_supplementary(reads: DataFrame, p: Params) -> DataFrame:
    """Of each entry of a read's SA tag: a breakend on another chromosome, else an inversion on the other strand, else a duplication beyond a gap."""
    rows = reads.where(F.col("sa").isNotNull()).withColumn("e", F.explode(supplementary.entries(F.col("sa")))).where(F.col("e.mapq") >= p.min_mapq)
    at, gap = F.col("e.pos"), F.abs(F.col("e.pos") - F.col("stop"))
    kind = F.when(F.col("e.chrom") != F.col("chrom"), "BND").when(F.col("e.strand") != F.col("strand"), F.when(gap >= p.min_sv_size, "INV")).when(gap > SHORT_GAP, "DUP")
    rows = rows.withColumn("sv_type", kind).where("sv_type IS NOT NULL")
    bnd = F.col("sv_type") == "BND"
    start = F.when(bnd, F.col("stop")).otherwise(F.least("start", at))
    stop = F.when(bnd, F.col("stop")).otherwise(F.greatest("stop", at))
    size = F.when(bnd, 0).when(F.col("sv_type") == "INV", F.abs(at - F.col("start"))).otherwise(F.col("stop") - F.col("start"))
    return _filled(
        rows.select(
            "chrom", "read_name", "ord", "sv_type", F.concat(F.lit("SA_"), "sv_type").alias("ev_type"), start.alias("start"), stop.alias("stop"), size.alias("size"), F.least("mapq", "e.mapq").alias("mapq"),
            F.when(bnd, F.col("e.chrom")).alias("chr2"), F.when(bnd, at).alias("pos2"), ((F.col("sv_type") == "DUP") & (gap > FAR_COPY)).alias("interspersed"),
        ),
        2,
    )


def _far_copy() -> tuple[dict[str, Column], Column, list[Column]]:
    before = Window.partitionBy("read_name").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # the alignments of one read
    first = F.first(F.when(F.col("primary"), F.struct("chrom", "start", "stop")), ignorenulls=True).over(before)
    real = ~F.col("primary") & (F.col("p.chrom") == F.col("chrom")) & (F.abs(F.col("start") - F.col("p.stop")) > FAR_COPY)
    given = {n: F.col(n) for n in ("chrom", "read_name", "mapq", "ord")} | {
        "ev_type": F.lit("INTER_DUP"), "sv_type": F.lit("DUP"), "start": F.least("start", "p.start"), "stop": F.greatest("stop", "p.stop"), "size": F.col("p.stop") - F.col("p.start"), "interspersed": F.lit(True),
    }
    return {"p": first}, real, _columns(given, 3)


def from_far_copies(reads: DataFrame) -> DataFrame:
    """A supplementary alignment far from the read's first primary one on the same chromosome, which must come before it."""
    return _of_reads(reads, _far_copy())


def orientation(strand1: Column, strand2: Column) -> Column:
    one, two = strand1 == "+", strand2 == "+"
    return F.when(one & two, "N[").when(one & ~two, "N]").when(~one & two, "[N").otherwise("]N")


def _segment() -> tuple[dict[str, Column], Column, list[Column]]:
    after = F.lead(F.struct("chrom", "start", "strand", "mapq", "primary")).over(Window.partitionBy("read_name").orderBy("start", "ord"))
    other = F.col("n.chrom") != F.col("chrom")
    real = F.col("n").isNotNull() & (F.col("primary") | F.col("n.primary")) & (other | (F.abs(F.col("n.start") - F.col("stop")) > FAR_SEGMENT))
    given = {n: F.col(n) for n in ("chrom", "read_name", "ord", "stop")} | {
        "ev_type": F.when(other, "SEGMENT_BND").otherwise("DISTANT_BND"), "sv_type": F.lit("BND"), "start": F.col("stop"), "size": F.lit(0), "mapq": F.least("mapq", "n.mapq"),
        "chr2": F.col("n.chrom"), "pos2": F.col("n.start"), "bnd_type": F.when(other, orientation(F.col("strand"), F.col("n.strand"))),
    }
    return {"n": after}, real, _columns(given, 5)


def from_segments(reads: DataFrame) -> DataFrame:
    """Neighbouring segments of a read, in the order of their starts alone: breakends between chromosomes, or far apart on one."""
    return _of_reads(reads, _segment())


def _of_reads(reads: DataFrame, *producers: tuple[dict[str, Column], Column, list[Column]]) -> DataFrame:
    """Evidence from the other alignments of a read. However many producers, alignments are dealt out by name once. A producer: what it looks up there, which rows give evidence, and that."""
    rows = _named(reads)
    for looked_up, *_ in producers:
        rows = rows.withColumns(looked_up)
    return rows.select(F.inline(F.array_compact(F.array(*(F.when(real, F.struct(*given)) for _, real, given in producers)))))


def from_depth(reads: DataFrame, contigs: DataFrame, p: Params) -> DataFrame:
    deep = depth.duplicated(depth.window_depth(reads, contigs, p.min_mapq), p.coverage, p.dup_depth_threshold)
    name = F.concat_ws("_", F.lit("depth"), "chrom", F.col("start").cast("string"))
    return _filled(deep.select("chrom", "start", "stop", "ev_type", F.lit("DUP").alias("sv_type"), (F.col("stop") - F.col("start")).alias("size"), name.alias("read_name"), F.lit(30).alias("mapq"), (F.col("ev_type") == "DEPTH_INTERSPERSED").alias("interspersed"), F.col("start").alias("ord")), 4)


def everything(alignments: DataFrame, contigs: DataFrame, p: Params) -> DataFrame:
    reads = usable(alignments)
    parts = [from_cigar(reads, p), from_supplementary(reads, p), from_depth(reads, contigs, p), _of_reads(reads, _far_copy(), _segment())]
    return reduce(DataFrame.unionByName, parts)
