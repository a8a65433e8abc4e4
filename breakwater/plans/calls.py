"""Calls from evidence: neighbours chained into clusters, clusters summed up, repeats annotated."""

from __future__ import annotations

from itertools import chain as flat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import has_homopolymer
from ..functions.statistics import similar, truncated_median
from ..operators import intervals, sequences
from ..params import Params

LEAST_ROWS = {"DUP": 3, "CPX": 7}  # fixed values of the method
CONTEXT = 20


def _by_type(table: dict, default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*flat.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), F.col("sv_type")), F.lit(default))


def clusters(evidence: DataFrame, p: Params) -> DataFrame:
    """Evidence with `cluster`, counted within type and chromosome. A row joins its predecessor unless it begins too far behind it or, but
    for breakends and complex events, differs too much in size."""
    most = _by_type(p.chain_distance, 1000)

    def breaks(before: Column) -> Column:
        unlike = ~F.col("sv_type").isin("BND", "CPX") & ~similar(F.col("size"), before["size"])
        return (F.col("start") - before["start"] > most) | unlike

    return sequences.chain(evidence, ["sv_type", "chrom"], "start", ["step", "ord", "size", "read_name"], ["size"], breaks)


def support(n: Column, n_reads: Column, n_depth: Column, n_split: Column) -> Column:
    """The weighted support of a cluster, by its type."""
    base = (n_reads + 5 * n_depth).cast("double")
    dup = F.when(n_depth > 0, F.greatest(base, 3.5 * n_depth + n_split)).otherwise(base)
    bnd = F.greatest(n_reads, n, F.when(n >= 2, 2 * n)).cast("double")
    return F.when(F.col("sv_type") == "DUP", dup).when(F.col("sv_type") == "BND", bnd).otherwise(base)


CLUSTER = ["sv_type", "chrom", "cluster"]


def _real() -> Column:
    return ~F.startswith("read_name", F.lit("depth_"))


def reads_of(clustered: DataFrame) -> DataFrame:
    """sv_type, chrom, cluster, read_name: which reads are in which cluster, each once. Depth windows and rows without a name are no reads."""
    return clustered.where(_real()).select(*CLUSTER, "read_name").distinct()


def summed(clustered: DataFrame, p: Params) -> DataFrame:
    """One call a cluster, with n_reads; reads_of() has the reads. Only complex calls, whose components are part of the output, hold an array.

    Most clusters are of one row and give no call: windows over a cluster tell its size, and medians are taken of the others alone. The windows' order
    tells which row is the first of its read, so reads are counted without a set."""
    kind = F.col("ev_type")
    real = _real()
    named = Window.partitionBy(*CLUSTER).orderBy("read_name")
    whole = named.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = ~F.col("read_name").eqNullSafe(F.lag("read_name").over(named))
    sized = clustered.withColumns({"_seen": seen, "_n": F.count("*").over(whole), "_deep": F.count(F.when(F.contains(kind, F.lit("DEPTH")), 1)).over(whole)})
    most = support(F.col("_n"), F.col("_n"), F.col("_deep"), F.col("_n"))  # if each row were a read of its own, and a split one
    clustered = sized.where((F.col("_n") >= _by_type(LEAST_ROWS, 1)) & ((F.col("sv_type") == "CPX") | (most >= F.when((F.col("sv_type") == "BND") | ((F.col("sv_type") == "DUP") & (F.col("_deep") > 0)), 1).otherwise(2))))
    by_order = F.struct("start", "step", "ord")
    mate = F.when(F.col("chr2").isNotNull(), F.struct("chr2", "pos2", "bnd_type"))
    rows = clustered.groupBy(*CLUSTER).agg(
        F.count("*").alias("n"),
        F.count(F.when(real & F.col("_seen"), 1)).alias("n_reads"),
        F.count(F.when(F.contains(kind, F.lit("DEPTH")), 1)).alias("n_depth"),
        F.count(F.when(F.contains(kind, F.lit("SA_")), 1)).alias("n_split"),
        F.count(F.when(kind.isin("SA_BND", "SEGMENT_BND"), 1)).alias("n_joined"),
        truncated_median("start").alias("start"),
        truncated_median("stop").alias("mid_stop"),
        truncated_median("size").alias("size"),
        F.min("start").alias("first"),
        F.max("stop").alias("last"),
        F.avg("mapq").cast("int").alias("mapq"),
        F.stddev_pop("start").alias("std_pos"),
        F.stddev_pop("size").alias("std_len"),
        F.coalesce(F.bool_or(F.contains(kind, F.lit("CIGAR"))), F.lit(False)).alias("precise"),
        F.coalesce(F.bool_or(F.col("interspersed") | F.contains(kind, F.lit("INTER"))), F.lit(False)).alias("interspersed"),
        F.min_by(mate, F.when(mate.isNotNull(), by_order)).alias("mate"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("sv_type") == "CPX") & (F.size("components") > 0), F.struct(by_order.alias("at"), F.col("components").alias("of"))))), lambda x: x["of"])).alias("components"),
    )
    rows = rows.where(F.col("n") >= _by_type(LEAST_ROWS, 1))
    n_reads = F.col("n_reads")
    rows = rows.withColumn("support", support(F.col("n"), n_reads, F.col("n_depth"), F.col("n_split")))
    bnd, cpx, dup, deep = F.col("sv_type") == "BND", F.col("sv_type") == "CPX", F.col("sv_type") == "DUP", F.col("n_depth") > 0
    least = F.when(bnd, 1).when(dup, F.when(deep, 1).otherwise(2)).otherwise(2)
    rows = rows.where(cpx | (F.col("support") >= least))
    stop = F.when(bnd, F.col("start")).when(F.col("mid_stop") > F.col("start"), F.col("mid_stop")).otherwise(F.col("start") + F.greatest("size", F.lit(1)))
    af = F.col("support") / max(1.0, p.coverage)
    return rows.select(
        "sv_type", "chrom", "cluster", F.when(cpx, F.col("first")).otherwise(F.col("start")).alias("start"), F.when(cpx, F.col("last")).otherwise(stop).alias("stop"),
        F.when(cpx, F.col("last") - F.col("first")).otherwise(F.col("size")).alias("size"), "support", "mapq", "n_reads",
        F.when(deep, "depth").otherwise("split_read").alias("source"), F.when(dup & deep, F.greatest(af, F.lit(0.15))).otherwise(af).alias("af"),
        "std_pos", F.when(bnd, 0.0).otherwise(F.col("std_len")).alias("std_len"), "precise",
        F.when(bnd, F.coalesce("mate.chr2", "chrom")).alias("mate_chr"), F.when(bnd, F.coalesce("mate.pos2", stop)).alias("mate_pos"), F.when(bnd, F.coalesce("mate.bnd_type", F.lit("N["))).alias("bnd_type"),
        F.when(bnd, F.col("n_joined")).otherwise(F.col("n_split")).alias("split_support"), (n_reads - F.col("n_split")).alias("spanning_support"), F.col("n_depth").alias("depth_support"),
        F.when(dup, F.when(F.col("interspersed"), "DUP:INTERSPERSED").otherwise("DUP:TANDEM")).alias("complex_type"), cpx.alias("is_complex"),
        F.when(cpx, F.when(F.size("components") > 0, F.col("components")).otherwise(F.array(F.lit("Unknown")))).alias("components"),
    )


def with_repeats(calls: DataFrame, repeats: DataFrame, chunks: DataFrame | None = None, chunk: int = 10_000, ids: tuple[str, ...] = ("sv_type", "chrom", "start", "stop")) -> DataFrame:
    """Adds in_repeat and repeat_type: a listed repeat that touches the call (ends count), else a homopolymer between CONTEXT bases before its start
    and as many after its stop. chunks: reference pieces of `chunk` bases that overlap the next by a homopolymer's length at least, schema.CHUNKS."""
    found = intervals.covered(calls, repeats, "chrom", ids, closed=True)
    if chunks is None:
        near = found.withColumn("_run", F.lit(False))
    else:
        left, right = F.greatest(F.lit(0), F.col("start") - CONTEXT), F.col("stop") + CONTEXT
        of_chunk = lambda at: (F.floor(at / chunk) * chunk).cast("bigint")
        touched = F.sequence(of_chunk(left), F.greatest(of_chunk(left), of_chunk(right - 1)), F.lit(chunk).cast("bigint"))
        keyed = found.select(*ids, left.alias("_left"), right.alias("_right"), F.explode(touched).alias("_s")).distinct()
        pieces = chunks.select(F.col("chrom"), F.col("chunk_start").alias("_s"), "seq")
        first = F.greatest(F.col("_left"), F.col("_s"))
        part = F.substring("seq", (first - F.col("_s") + 1).cast("int"), F.greatest(F.lit(0), F.col("_right") - first).cast("int"))
        runs = keyed.join(pieces, ["chrom", "_s"]).where(has_homopolymer(F.upper(part))).select(*ids).distinct()
        near = found.join(runs.withColumn("_run", F.lit(True)), list(ids), "left").fillna(False, ["_run"])
    listed = F.col("covered") & ~F.col("is_complex")
    run = F.col("_run") & ~F.col("is_complex")
    return near.withColumn("in_repeat", listed | run).withColumn("repeat_type", F.when(listed, "tandem").when(run, "homopolymer")).drop("covered", "_run")
