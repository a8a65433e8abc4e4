"""Aggregate tables about call sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variant_fields as fields


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def type_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("sv_type").agg(F.count("*").alias("n"), _n(F.col("filter") == "PASS").alias("passed"))


def pass_rates(calls: DataFrame) -> DataFrame:
    """Whole percent of rows whose filter contains PASS, by caller; 0 of nothing."""
    return calls.groupBy("caller").agg(F.count("*").alias("n"), _n(F.contains("filter", F.lit("PASS"))).alias("passed")).withColumn("percent", F.floor(100 * F.col("passed") / F.col("n")).cast("bigint"))


def filter_reasons(calls: DataFrame) -> DataFrame:
    return calls.select(F.explode(F.split("filter", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reason_shares(calls: DataFrame) -> DataFrame:
    """place, reason, n, percent: why calls didn't pass, the commonest reason first, with the share of all calls that have it."""
    total = calls.agg(F.count("*").alias("_total"))
    reasons = filter_reasons(calls.where(F.col("filter") != "PASS")).crossJoin(F.broadcast(total))  # one row
    return reasons.select(F.row_number().over(Window.orderBy(F.desc("n"), "reason")).alias("place"), "reason", "n", (100 * F.col("n") / F.col("_total")).alias("percent")).orderBy("place")  # a row a reason


def type_quality(calls: DataFrame) -> DataFrame:
    """By type: all calls, those that passed, their percentage and the mean quality."""
    passed = _n(F.col("filter") == "PASS")
    return calls.groupBy("sv_type").agg(F.count("*").alias("n"), passed.alias("passed"), (100 * passed / F.count("*")).alias("percent"), F.avg("qual").alias("mean_qual"))


def component_counts(calls: DataFrame) -> DataFrame:
    """component, n: how often each type is part of a complex call, the commonest first."""
    return calls.where(F.col("sv_type") == "CPX").select(F.explode("components").alias("component")).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component")


def outcomes(states: DataFrame, by: str = "caller") -> DataFrame:
    """caller, outcome, n: true and false positives and false negatives, also those that a caller has none of. states: of evaluation.match, with a caller."""
    counts = states.groupBy(by).agg(*(_n(F.col("state") == s).alias(s) for s in ("TP", "FP", "FN")))
    return counts.unpivot([by], ["TP", "FP", "FN"], "outcome", "n")


def summary_outcomes(summaries: DataFrame) -> DataFrame:
    """The same of summaries that give the counts: caller, tp, fp, fn."""
    return summaries.select("caller", *(F.col(s.lower()).alias(s) for s in ("TP", "FP", "FN"))).unpivot(["caller"], ["TP", "FP", "FN"], "outcome", "n")


TYPES = ("DEL", "INS", "DUP", "INV", "BND", "CPX")


def detection(truth: DataFrame, calls: DataFrame, where: Column | None = None) -> DataFrame:
    """place, sv_type, truth, detected, rate: of each type in its usual order, the true variants, the calls that passed and their ratio in percent; null
    without any true ones. where: a condition on both sides, as to lie in a repeat."""
    rows = truth.select("sv_type", "in_repeat", F.lit(True).alias("real")).unionByName(calls.where(F.col("filter") == "PASS").select("sv_type", "in_repeat", F.lit(False).alias("real")))
    rows = rows.where(where) if where is not None else rows
    counts = rows.groupBy("sv_type").agg(_n(F.col("real")).alias("truth"), _n(~F.col("real")).alias("detected"))
    kinds = calls.sparkSession.createDataFrame(list(enumerate(TYPES)), "place int, sv_type string")
    both = kinds.join(counts, "sv_type", "left").select("place", "sv_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("truth", "detected")))
    return both.withColumn("rate", F.when(F.col("truth") > 0, 100 * F.col("detected") / F.col("truth"))).orderBy("place")


def dup_subtypes(calls: DataFrame) -> DataFrame:
    """By caller, passed duplications that are interspersed or else tandem."""
    dup = calls.where((F.col("sv_type") == "DUP") & (F.col("filter") == "PASS"))
    far = F.contains("dup_subtype", F.lit("INTERSPERSED"))
    return dup.groupBy("caller").agg(_n(far).alias("interspersed"), _n(~F.coalesce(far, F.lit(False))).alias("tandem"))


def repeat_overview(calls: DataFrame) -> DataFrame:
    passed = F.col("filter") == "PASS"
    return calls.groupBy("caller").agg(_n(passed & F.col("in_repeat")).alias("in_repeat"), _n(passed & ~F.col("in_repeat")).alias("outside"))


def repeat_types(calls: DataFrame) -> DataFrame:
    """Passed calls in repeats by a normalised label."""
    low = F.lower(F.coalesce("repeat_type", F.lit("")))
    label = F.when(low == "", "Unspecified Repeat").when(F.contains(low, F.lit("homopolymer")), "Homopolymer").when(F.contains(low, F.lit("tandem")), "Tandem Repeat").when(F.contains(low, F.lit("low")), "Low Complexity").otherwise("Other")
    return calls.where((F.col("filter") == "PASS") & F.col("in_repeat")).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def genotype_classes(calls: DataFrame) -> DataFrame:
    """By caller, passed calls of each genotype class and the shares of het and hom."""
    kind = fields.genotype_class(F.col("genotype"))
    rows = calls.where(F.col("filter") == "PASS").withColumn("class", kind)
    counts = rows.groupBy("caller").agg(*(_n(F.col("class") == c).alias(c.lower()) for c in ("het", "hom", "ref", "Unknown")), F.count("*").alias("n"))
    return counts.withColumn("het_rate", F.col("het") / F.greatest(F.lit(1), "n")).withColumn("hom_rate", F.col("hom") / F.greatest(F.lit(1), "n"))


def size_histogram(calls: DataFrame, low: float = 10.0, high: float = 1e6, bins: int = 24) -> DataFrame:
    """By type, how many sizes fall into each of `bins` equal parts of the logarithm between low and high, and the median of all sizes of the
    type."""
    step = F.floor((F.log10("size") - F.log10(F.lit(low))) / ((F.log10(F.lit(high)) - F.log10(F.lit(low))) / bins)).cast("bigint")
    rows = calls.where((F.col("filter") == "PASS") & (F.col("size") > 0)).withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), step)).cast("bigint"))
    medians = rows.groupBy("sv_type").agg(F.percentile("size", F.lit(0.5)).alias("median"))
    return rows.groupBy("sv_type", "bin").agg(F.count("*").alias("n")).join(medians, "sv_type")


def _sides(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """panel, side, size: duplications by their kind, calls that passed."""
    panel = F.when(F.col("sv_type") == "DUP", F.concat(F.lit("DUP_"), "dup_subtype")).otherwise(F.col("sv_type"))
    rows = lambda df, side: df.select(panel.alias("panel"), F.lit(side).alias("side"), "size")
    return rows(truth, "truth").unionByName(rows(calls.where(F.col("filter") == "PASS"), "detected")).where("panel IS NOT NULL")


def size_distributions(truth: DataFrame, calls: DataFrame, bins: int = 24, least: int = 50) -> DataFrame:
    """panel, scale, side, bin, low, high, n, density: sizes over 0 of true variants and of calls that passed, in bins whose edges come from the data of both
    sides. From `least` (or the smallest size, if larger) to the largest, the edges are equally far apart by their logarithms; if no size is over `least`, by themselves,
    from the smallest on. n / (all in the bins x width) is the density. Where all sizes are equal, and for breakends, which have none, there are counts alone.

    One pass finds the ends, a row a panel, and one counts. A size on an edge belongs to the upper bin, the largest to the last."""
    rows = _sides(truth, calls)
    sized = rows.where((F.col("panel") != "BND") & (F.col("size") > 0))
    ends = sized.groupBy("panel").agg(F.min("size").cast("double").alias("first"), F.max("size").cast("double").alias("last"))
    log = F.col("last") > F.greatest("first", F.lit(least))
    scale = F.when(F.col("last") == F.col("first"), "count").when(log, "log").otherwise("linear")
    ends = ends.select("panel", scale.alias("scale"), F.when(log, F.greatest("first", F.lit(float(least)))).otherwise(F.col("first")).alias("first"), "last")
    share = F.when(F.col("scale") == "log", (F.log10("size") - F.log10("first")) / (F.log10("last") - F.log10("first"))).when(F.col("scale") == "linear", (F.col("size") - F.col("first")) / (F.col("last") - F.col("first")))
    placed = sized.join(F.broadcast(ends), "panel").where(F.col("size").between(F.col("first"), F.col("last")))  # a row a panel
    counts = placed.groupBy("panel", "scale", "side", "first", "last", F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("panel", "side")))  # a row a bin

    def edge(k: Column) -> Column:
        along = k / bins
        logs = F.log10("first") + along * (F.log10("last") - F.log10("first"))
        inner = F.when(F.col("scale") == "log", F.pow(F.lit(10.0), logs)).otherwise(F.col("first") + along * (F.col("last") - F.col("first")))
        return F.when(k == 0, F.col("first")).when(k == bins, F.col("last")).when(F.col("scale") != "count", inner)

    low, high = edge(F.col("bin")), edge(F.col("bin") + 1)
    out = counts.select("panel", "scale", "side", "bin", F.when(F.col("scale") != "count", low).alias("low"), F.when(F.col("scale") != "count", high).alias("high"), "n", F.when(F.col("scale") != "count", F.col("n") / (F.col("total") * (high - low))).alias("density"))
    nothing = F.lit(None).cast("double")
    ends_only = rows.where("panel = 'BND'").groupBy("panel", "side").agg(F.count("*").alias("n")).select("panel", F.lit("count").alias("scale"), "side", F.lit(None).cast("int").alias("bin"), nothing.alias("low"), nothing.alias("high"), "n", nothing.alias("density"))
    return out.unionByName(ends_only)


def size_medians(truth: DataFrame, calls: DataFrame, width: int = 65_536) -> DataFrame:
    """panel, side, n, median of the sizes over 0, where there are two at least: exact, of an even number the lower of the two in the middle. Equal sizes are
    counted first; bins of `width` sizes tell which of them the median is in, and only that one is put in order."""
    by = ["panel", "side"]
    counts = _sides(truth, calls).where((F.col("panel") != "BND") & (F.col("size") > 0)).groupBy(*by, "size").agg(F.count("*").alias("_c")).withColumn("_bin", F.floor(F.col("size") / width))
    bins = counts.groupBy(*by, "_bin").agg(F.sum("_c").alias("_of_bin"))  # one row a bin
    every = Window.partitionBy(*by)
    bins = bins.withColumns({"n": F.sum("_of_bin").over(every), "_upto": F.sum("_of_bin").over(every.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))})
    place = F.floor((F.col("n") + 1) / 2)
    bins = bins.where((F.col("n") > 1) & (F.col("_upto") >= place) & (F.col("_upto") - F.col("_of_bin") < place))
    inside = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(bins), [*by, "_bin"]).withColumn("_at", F.col("_upto") - F.col("_of_bin") + F.sum("_c").over(inside)).where(F.col("_at") >= place)
    return placed.groupBy(*by, "n").agg(F.min("size").alias("median"))


def caller_overlap(calls: DataFrame, width: int = 100) -> DataFrame:
    """How many places (chromosome, bucket, type) each set of callers has, as a bit mask: all regions of a Venn diagram."""
    place = [F.col("chrom"), fields.bucket(F.col("start"), width).alias("bucket"), F.col("sv_type")]
    bit = F.expr("shiftleft(cast(1 as bigint), cast(caller as int))")
    masks = calls.where(F.col("filter") == "PASS").groupBy(*place).agg(F.bit_or(bit).alias("mask"))
    return masks.groupBy("mask").agg(F.count("*").alias("n"))


def patterns(calls: DataFrame, first: int | None = None) -> DataFrame:
    """Sorted component lists of complex calls and how often each occurs; the `first` commonest, or all."""
    key = F.array_join(F.array_sort("components"), ",").alias("pattern")
    counts = calls.where(F.size("components") > 0).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "pattern").limit(first) if first else counts


def long_metrics(summaries: DataFrame) -> DataFrame:
    """caller, metric, value rows of precision, recall and f1."""
    return summaries.unpivot(["caller"], ["precision", "recall", "f1"], "metric", "value")
