"""The whole caller: alignments to filtered calls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import depth
from ..params import Params
from ..sources.tables import stored
from . import calls, complexes, evidence, genotyping, scoring


def call_variants(alignments: DataFrame, contigs: DataFrame, repeats: DataFrame, chunks: DataFrame | None = None, p: Params | None = None) -> DataFrame:
    """Calls with genotype, quality and filter. alignments, contigs, repeats and chunks: the tables of schema. Each step is a table in the shared folder;
    which reads a call has is a table beside it, call_id and read_name."""
    p = p or Params()
    reads = evidence.usable(alignments)
    p = replace(p, coverage=depth.coverage(reads, contigs, p.coverage).first()["coverage"])
    simple = stored(evidence.everything(alignments, contigs, p), "evidence")
    windows = complexes.single_read_windows(simple.where("NOT startswith(read_name, 'depth_')"))
    clustered = calls.clusters(simple.unionByName(windows), p)
    call_id = F.xxhash64("sv_type", "chrom", "cluster", F.lit(False)).alias("call_id")
    found = stored(calls.summed(clustered, p).select("*", call_id), "calls")
    own = stored(calls.reads_of(clustered).select(call_id, "read_name").join(found.select("call_id"), "call_id", "left_semi"), "reads")
    plain = found.where("NOT is_complex")
    events, event_reads = complexes.shared_read_events(plain, own, p)
    event_id = F.xxhash64("event", F.lit(True)).alias("call_id")
    events = events.select("*", event_id).drop("event").withColumns({
        "sv_type": F.lit("CPX"), "cluster": F.lit(0).cast("bigint"), "af": F.col("support") / max(1.0, p.coverage), "is_complex": F.lit(True), "std_pos": F.lit(0.0), "std_len": F.lit(0.0), "precise": F.lit(False), "source": F.lit("split_read"),
        "split_support": F.lit(0), "spanning_support": F.lit(0), "depth_support": F.lit(0), "n_reads": F.col("support").cast("bigint"),
    })
    every = found.unionByName(events, allowMissingColumns=True)
    own = own.unionByName(event_reads.select(event_id, "read_name"))
    noted = stored(calls.with_repeats(every, repeats, chunks, ids=("call_id",)), "annotated")
    typed = genotyping.strands(genotyping.genotype(noted, own, reads, contigs, p), own, reads)
    return scoring.with_filters(scoring.with_quality(typed, p), p)
