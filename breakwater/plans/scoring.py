"""Quality scores and soft filters, as decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import poisson_cdf
from ..params import Params
from .calls import _by_type


def support_score(support: Column, genotype: Column, coverage: float, ploidy: int) -> Column:
    mean = F.lit(coverage / ploidy) * F.when(genotype == "1/1", 2.0).otherwise(1.0)
    upper, lower = -10 * F.log10(1 - poisson_cdf(support - 1, mean) + 1e-10), -10 * F.log10(poisson_cdf(support, mean) + 1e-10)
    surprise = F.least(F.lit(60.0), F.when(support >= mean, upper).otherwise(lower))
    return F.when(support == 0, 0.0).when(mean <= 0, F.least(F.lit(60.0), 3.0 * support)).otherwise(surprise)


def strand_score(forward: Column, reverse: Column) -> Column:
    total = forward + reverse
    return F.when(total == 0, 0.0).when(F.least(forward, reverse) / total < 0.1, 10.0).otherwise(30.0)


def position_score(std_pos: Column, size: Column) -> Column:
    share = F.round(std_pos, 9) / F.greatest(size, F.lit(1))  # partial sums end in different last bits, and the thresholds shouldn't depend on that
    return F.when(F.round(std_pos, 9) == 0, 40.0).when(share < 0.1, 35.0).when(share < 0.3, 25.0).when(share < 0.5, 15.0).otherwise(5.0)


def af_score(af: Column) -> Column:
    return F.when(af < 0.1, 5.0).when(af < 0.2, 15.0).when(af < 0.35, 25.0).otherwise(30.0)


def with_quality(calls: DataFrame, p: Params) -> DataFrame:
    """Adds qual. calls: sv_type, support, genotype, forward, reverse, std_pos, std_len, size, af, split_support, depth_support, repeat_type."""
    total = 0.4 * support_score(F.col("support"), F.col("genotype"), p.coverage, p.ploidy)
    total = total + 0.2 * strand_score(F.col("forward"), F.col("reverse")) + 0.2 * position_score(F.col("std_pos"), F.col("size")) + 0.2 * af_score(F.col("af"))
    kind = F.col("sv_type")
    factor = F.when((kind == "BND") & (F.col("split_support") > 0), 1.2).when((kind == "DUP") & (F.col("depth_support") > 0), 1.3).when((kind == "INS") & (F.round("std_len", 9) < 10), 1.1).otherwise(1.0)
    again = F.when(F.col("repeat_type") == "homopolymer", 0.7).when(F.col("repeat_type") == "low_complexity", 0.8).otherwise(1.0)
    return calls.withColumn("qual", F.least(F.lit(99.0), total * factor * again))


def thresholds(calls: DataFrame, p: Params) -> DataFrame:
    """Adds min_support and min_af, by type, repeat and kind of support."""
    kind, inside, deep = F.col("sv_type"), F.col("in_repeat"), F.col("source") == "depth"
    support, af = _by_type(p.min_support, 3), _by_type(p.min_af, 0.15)
    dup_deep = F.when(inside, deep | (F.col("depth_support") > 2)).otherwise(deep & (F.col("depth_support") >= 2))
    scaled = F.greatest(F.lit(1), (support * _by_type(p.repeat_modifier, 1.0)).cast("int"))
    least = (
        F.when(kind == "DUP", F.when(dup_deep, 2).otherwise(3)).when(kind == "BND", support).when(inside, scaled)
        .when(kind == "DEL", F.greatest(F.lit(1), support - 1)).when(kind.isin("INS", "CPX"), support + 1).otherwise(support)
    )
    share = (
        F.when(kind == "DUP", F.lit(p.dup_min_af)).when(kind == "BND", F.when(inside, af).otherwise(af * 0.8)).when(inside, F.when(kind == "CPX", af * 0.8).otherwise(af * 1.1))
        .when(kind == "DEL", af * 0.4).when(kind.isin("INS", "CPX"), af * 1.1).otherwise(af)
    )
    return calls.withColumn("min_support", least.cast("bigint")).withColumn("min_af", share)


def with_filters(calls: DataFrame, p: Params) -> DataFrame:
    """Adds filter: PASS, or the labels that hold, joined by semicolons."""
    kind, qual = F.col("sv_type"), F.col("qual")
    low = F.when(kind.isin("BND", "DEL"), 4).otherwise(10)
    labels = F.array_compact(F.array(F.when(F.col("support") < F.col("min_support"), "MinSupport"), F.when(F.col("af") < F.col("min_af"), "MinAF"), F.when(qual < low, "LowQual")))
    rescued = (kind == "DUP") & (qual >= 20)
    deep = rescued & (F.col("source") == "depth") & (F.col("depth_support") >= 3)
    kept = (
        F.when(deep, F.expr("cast(array() as array<string>)")).when(rescued, F.array_remove(labels, "MinAF"))
        .when((kind == "BND") & (F.col("support") >= 1), F.array_remove(labels, "MinSupport")).otherwise(labels)
    )
    return thresholds(calls, p).withColumn("filter", F.when(F.size(kept) == 0, "PASS").otherwise(F.array_join(kept, ";")))
