"""Statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k), summed in the log domain; 0 below 0."""
    logs = F.struct(F.lit(0.0).alias("term"), F.exp(-mean).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(mean) - F.log(i)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term - mean)).alias("total"))

    last = F.floor(k).cast("int")
    terms = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(k < 0, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, logs, add, lambda acc: acc["total"])))


def truncated_median(col: str) -> Column:
    """The exact median, truncated towards zero."""
    return F.percentile(col, F.lit(0.5)).cast("bigint")


def similar(a: Column, b: Column, most: float = 0.5) -> Column:
    """Whether two sizes differ by less than that share of the larger."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1)) < most
