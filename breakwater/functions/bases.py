"""Bases: complements, runs and tandem units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 12


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def has_homopolymer(seq: Column, run: int = RUN, letters: str = "ATGC") -> Column:
    return seq.rlike("|".join(f"{c}{{{run}}}" for c in letters))


def tandem_prefix(seq: Column, copies: int = 4) -> Column:
    """Whether the text begins with that many copies of a unit of two or three."""
    return seq.rlike(rf"^(..)\1{{{copies - 1}}}") | seq.rlike(rf"^(...)\1{{{copies - 1}}}")


def repeat_kind(seq: Column) -> Column:
    return F.when(has_homopolymer(seq), "homopolymer").when(tandem_prefix(seq), "tandem")
