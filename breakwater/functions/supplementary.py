"""The SA tag: other alignments of a read, as `chrom,pos,strand,cigar,mapq,nm;...` with 1-based positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(sa: Column) -> Column:
    """array<struct<chrom, pos (0-based), strand, mapq>> of the complete entries; null has none."""
    parts = F.transform(F.filter(F.split(F.coalesce(sa, F.lit("")), ";"), lambda x: x != ""), lambda x: F.split(x, ","))
    whole = F.filter(parts, lambda p: F.size(p) >= 6)
    fields = F.transform(whole, lambda p: F.struct(p[0].alias("chrom"), (p[1].try_cast("bigint") - 1).alias("pos"), p[2].alias("strand"), p[4].try_cast("int").alias("mapq")))
    return F.filter(fields, lambda x: x["pos"].isNotNull() & x["mapq"].isNotNull())


def distant(sa: Column, chrom: Column, at: Column, distance: int = 50_000) -> Column:
    """How many entries name the chromosome (as a part of any of their text) and lie further than distance from a position; their position counts as it stands, 1-based."""
    parts = F.filter(F.split(F.coalesce(sa, F.lit("")), ";"), lambda x: (x != "") & F.contains(x, chrom))
    places = F.transform(parts, lambda x: F.get(F.split(x, ","), F.lit(1)).try_cast("bigint"))
    return F.size(F.filter(places, lambda p: F.abs(p - at) > distance))
