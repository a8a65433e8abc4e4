"""Fields of VCF rows as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPEATS = ("homopolymer", "tandem", "low_complexity", "repeat")


def info_map(info: Column) -> Column:
    """INFO as a map; a flag has the value null, of repeated keys the last counts."""
    pairs = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: x != "")
    keys = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    values = F.transform(pairs, lambda x: F.when(F.contains(x, F.lit("=")), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2)))
    entries = F.reverse(F.arrays_zip(keys.alias("key"), values.alias("value")))
    last = F.filter(entries, lambda x, i: F.array_position(F.transform(entries, lambda y: y["key"]), x["key"]) == i + 1)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(last))


def genotype(form: Column, sample: Column) -> Column:
    """The GT value, or ./. where there is none or FORMAT and sample differ in length."""
    names, values = F.split(F.coalesce(form, F.lit("")), ":"), F.split(F.coalesce(sample, F.lit("")), ":")
    at = F.array_position(names, "GT").cast("int")
    return F.when((at > 0) & (F.size(names) == F.size(values)), F.get(values, at - 1)).otherwise("./.")


def genotype_class(gt: Column) -> Column:
    return F.when(gt.isin("0/1", "1/0", "0|1", "1|0"), "het").when(gt.isin("1/1", "1|1"), "hom").when(gt.isin("0/0", "0|0"), "ref").otherwise("Unknown")


def dup_subtype(alt: Column, dup_type: Column, info: Column) -> Column:
    """Of a duplication: from ALT, then DUPTYPE, then the INFO text; tandem without any sign."""
    alt, dup_type, info = (F.upper(F.coalesce(x, F.lit(""))) for x in (alt, dup_type, info))
    far = lambda x: F.contains(x, F.lit("INTERSPERSED")) | F.contains(x, F.lit("DUP:INT"))
    near = lambda x: F.contains(x, F.lit("TANDEM"))
    out = F.when(far(alt), "INTERSPERSED").when(near(alt), "TANDEM").when(F.contains(dup_type, F.lit("INT")), "INTERSPERSED").when(near(dup_type), "TANDEM")
    return out.when(far(info), "INTERSPERSED").otherwise("TANDEM")


def repeat_flag(value: Column) -> Column:
    low = F.lower(value)
    return F.when(value.isNull(), False).when(low.isin("no", "false", "0"), False).otherwise(True)


def repeat_label(value: Column) -> Column:
    low = F.lower(value)
    return F.when(~repeat_flag(value), None).when(low.isin("yes", "true", "1"), "Unknown").otherwise(value)


def bucket(pos: Column, width: int) -> Column:
    """Floor division, also below zero."""
    return F.floor(pos / width).cast("bigint")
