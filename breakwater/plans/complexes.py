"""Events of several breakpoints: windows of evidence that one read spans, and calls that share reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals, sequences
from ..operators.intervals import Contained
from ..operators.sequences import key_runs
from ..params import Params
from ..sources.tables import stored
from .evidence import _filled


def single_read_windows(evidence: DataFrame, span: int = 1000) -> DataFrame:
    """Anchored windows of evidence with two rows or more that are all of one read, as complex evidence. Windows are sought in a row a place, with hashes of names; the
    evidence of those that may be of one read is joined to them, and names decide."""
    named = evidence.where("read_name IS NOT NULL")
    name = F.xxhash64("read_name")
    places = stored(named.where("start IS NOT NULL").groupBy("chrom", "start").agg(F.count("*").alias("n"), F.min(name).alias("least"), F.max(name).alias("most")), "places")
    windows = sequences.anchored(places, "chrom", "start", span)
    alone = windows.groupBy("chrom", "anchor").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).where("n >= 2 AND least = most")
    near = stored(windows.join(alone.select("chrom", "anchor"), ["chrom", "anchor"]).select("chrom", "start", "anchor"), "windows")
    grouped = named.join(near, ["chrom", "start"]).groupBy("chrom", "anchor").agg(
        F.count("*").alias("n"), F.min("read_name").alias("read_name"), F.max("read_name").alias("_other"), F.min("start").alias("first"), F.max("stop").alias("last"),
        F.avg("mapq").cast("int").alias("mapq"), F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("start", "step", "ord", "sv_type"))), lambda x: x["sv_type"]).alias("components"),
    )
    found = grouped.where((F.col("n") >= 2) & (F.col("read_name") == F.col("_other")))
    return _filled(found.select("chrom", F.col("first").alias("start"), F.col("last").alias("stop"), (F.col("last") - F.col("first")).alias("size"), "read_name", "mapq", "ord", "components", F.lit("CPX").alias("sv_type"), F.lit("COMPLEX_WINDOW").alias("ev_type")), 6)


BLOCK = 16_384  # calls whose neighbours are looked for together
FOUND = "key bigint, anchor bigint, last bigint, more array<bigint>"


def _good(starts: np.ndarray, stops: np.ndarray, at: np.ndarray, read: np.ndarray, p: Params, taken: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Calls that can begin an event, among calls in order, but those taken when their turn comes: the call, the last one near by distance, and nearer ones
    beyond that share a read with it. at and read: which calls a read is in, sorted by read and call."""
    n = len(starts)
    same = read[1:] == read[:-1]
    again = same[1:] & same[:-1]
    every = np.arange(n)
    sure = np.searchsorted(starts, stops + min(p.merge_distance, p.complex_distance), "right") - 1  # calls up to here are near by distance alone
    far = np.searchsorted(starts, stops + p.complex_distance, "right") - 1  # up to here if a read is in both
    sure, far = np.maximum(sure, every), np.maximum(far, every)
    # A read in m calls of a run has m - 1 pairs of neighbours in it and m - 2 of neighbours but one: the difference is 1 if m is 2 or more.
    shared = Contained(at[:-1][same], at[1:][same]).within(every, sure) - Contained(at[:-2][again], at[2:][again]).within(every, sure)
    of_call = np.argsort(at, kind="stable")
    begins = np.searchsorted(at[of_call], np.arange(n + 1))
    ends = np.searchsorted(read, read, "right")
    for i in np.flatnonzero((far > sure) | ((sure > every) & (shared >= p.complex_reads))).tolist():
        if taken[i]:
            continue
        more: set[int] = set()
        if far[i] > sure[i]:
            for q in of_call[begins[i] : begins[i + 1]]:
                later = at[q:ends[q]]
                more.update(later[(later > sure[i]) & (later <= far[i])].tolist())
        if more:
            near = np.concatenate([np.arange(i, sure[i] + 1), np.array(sorted(more))])
            names = read[np.concatenate([of_call[begins[j] : begins[j + 1]] for j in near])]
            enough = int((np.unique(names, return_counts=True)[1] >= 2).sum()) >= p.complex_reads
        else:
            enough = sure[i] > i and shared[i] >= p.complex_reads
        if enough:
            yield i, int(sure[i]), sorted(more)


def _anchors(starts: np.ndarray, stops: np.ndarray, at: np.ndarray, read: np.ndarray, p: Params) -> Iterator[tuple[int, np.ndarray]]:
    """Anchors of events and their calls, of all calls of a chromosome. A call that went into an event begins no other."""
    taken = np.zeros(len(starts), bool)
    for i, last, more in _good(starts, stops, at, read, p, taken):
        near = np.concatenate([np.arange(i, last + 1), np.array(more, np.int64)])
        taken[near] = True
        yield i, near


def _blocks(p: Params, width: int):
    """Of each block's own calls, those that can begin an event. A block is whole numbers alone: three for a call, two for a read in a call."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in key_runs(batches, "block"):
            yield from found(block)

    def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
        call = block["read"].is_null().to_numpy()
        calls, reads = block.filter(pa.array(call)), block.filter(pa.array(~call))
        first, key = block["block"][0].as_py(), block["key"][0].as_py()
        n = calls["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        n = n[order]
        read = reads["read"].to_numpy()
        at = np.searchsorted(n, reads["n"].to_numpy())
        by_read = np.lexsort((at, read))
        halo = n // width != first // width
        good = list(_good(calls["start"].to_numpy()[order], calls["stop"].to_numpy()[order], at[by_read], read[by_read], p, halo))
        if good:
            i, last, more = zip(*good, strict=True)
            cols = [pa.array(np.full(len(i), key)), pa.array(n[list(i)]), pa.array(n[list(last)]), pa.array([n[x].tolist() for x in more], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "anchor", "last", "more"])

    return of


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of calls that can begin an event, in order, those that no event before them holds: a stream that remembers how far the last event goes."""
    upto, beyond = -1, set()
    for batch in batches:
        anchor, last, more, kept, k = batch["anchor"].to_numpy(), batch["last"].to_numpy(), batch["more"], [], 0
        while (k := max(k, int(np.searchsorted(anchor, upto, "right")))) < len(anchor):
            if (at := int(anchor[k])) not in beyond:
                kept.append(k)
                upto = int(last[k])
                beyond = {x for x in beyond if x > upto} | set(more[k].as_py())
            k += 1
        if kept:
            yield batch.take(pa.array(kept))


def _good_by_place(placed: DataFrame, named: DataFrame, p: Params, width: int) -> DataFrame:
    """Calls that can begin an event, where distance alone makes neighbours: those of a call are the calls from it to the last that begins near, so they share as many
    reads as have two calls in that run. A read in m calls of a run has m - 1 calls in it with the read's next one in it, and m - 2 with the next but one. They
    are counted by blocks of `width` calls: a call over half a chromosome takes no copies of the calls and reads in it."""
    key = F.xxhash64("chrom").alias("key")
    near = placed.select("chrom", "n", (F.col("stop") + p.complex_distance + 1).alias("at"))
    begun = intervals.earlier(near, placed.select("chrom", F.col("start").alias("at"), F.lit(1).alias("begun")), "chrom", "at", "begun")
    first = placed.groupBy("chrom").agg(F.min("n").alias("first"))  # a row a chromosome
    last = F.col("first") + F.col("begun") - 1
    runs = stored(begun.join(F.broadcast(first), "chrom").where(last > F.col("n")).select(key, F.col("n").alias("anchor"), last.alias("last")), "complex-runs")
    nexts = Window.partitionBy("key", "read").orderBy("x")
    of_read = named.join(placed.select("call_id", key, F.col("n").alias("x")), "call_id").select("key", "x", F.xxhash64("read_name").alias("read"))
    points = of_read.withColumns({"y": F.lead("x").over(nexts), "z": F.lead("x", 2).over(nexts)}).where("y IS NOT NULL").drop("read")
    shared = intervals.contained(runs.select(F.col("anchor").alias("id"), "key", F.col("anchor").alias("low"), F.col("last").alias("high")), points, width)
    enough = shared.groupBy(F.col("id").alias("anchor")).agg(F.sum("n").alias("n")).where(F.col("n") >= p.complex_reads).select("anchor")
    return runs.join(enough, "anchor").select("key", "anchor", "last", F.expr("cast(array() as array<bigint>)").alias("more"))


def _good_by_read(placed: DataFrame, named: DataFrame, p: Params, width: int) -> DataFrame:
    """Calls that can begin an event, where sharing a read makes neighbours too. A block's task holds its calls and those after them that can be their neighbours, and
    an index of their reads, hashed: 16 bytes a read in a call. A very long call makes its block's neighbours many."""
    reach = F.greatest("start", F.col("stop") + p.complex_distance) + 1
    blocks = placed.groupBy("chrom", F.floor(F.col("n") / width).alias("nth")).agg(F.min("n").alias("block"), F.min("start").alias("start"), F.max(reach).alias("stop")).drop("nth")  # a row a block
    points = placed.select("chrom", "start", (F.col("start") + 1).alias("stop"), "n", "call_id", F.col("stop").alias("end"))
    met = intervals.overlaps(blocks, points, "chrom").where("r_n >= block")
    rows = stored(met.select("block", F.xxhash64("chrom").alias("key"), F.col("r_n").alias("n"), F.col("r_start").alias("start"), F.col("r_end").alias("stop"), F.col("r_call_id").alias("call_id")), "complex-blocks")
    nothing = F.lit(None).cast("bigint")
    index = named.join(rows.select("call_id", "block", "key", "n"), "call_id").select("block", "key", "n", nothing.alias("start"), nothing.alias("stop"), F.xxhash64("read_name").alias("read"))
    both = rows.select("block", "key", "n", "start", "stop", nothing.alias("read")).unionByName(index)
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks(p, width), FOUND)


def shared_read_events(calls: DataFrame, own: DataFrame, p: Params, width: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Events of neighbouring calls with enough reads in common: event, chrom, start, stop, size, support, mapq, components; and their reads: event, read_name.
    calls: call_id, chrom, start, stop, mapq, sv_type; own: call_id, read_name, each once.

    A call's neighbours begin at most merge_distance after its end, or complex_distance if they share one of its reads. Which calls can begin an event depends on their neighbours alone, and
    which of them do is a stream over these few numbers, in order. Names come back by a join. Reads without a name count in no call."""
    kept = calls.where("chrom IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL").select("call_id", "chrom", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), F.coalesce("mapq", F.lit(0)).alias("mapq"), "sv_type")
    placed = stored(sequences.numbered(kept, "chrom", "start", ["stop", "sv_type", "mapq", "call_id"], "n"), "complex-calls")
    named = own.where("read_name IS NOT NULL")
    good = _good_by_place(placed, named, p, width) if p.merge_distance >= p.complex_distance else _good_by_read(placed, named, p, width)
    chosen = good.repartition("key").sortWithinPartitions("anchor").mapInArrow(_chosen, FOUND)
    members = stored(chosen.select("anchor", F.explode(F.concat(F.sequence("anchor", "last"), "more")).alias("n")), "complex-members")
    met = members.join(placed, "n")
    reads = stored(met.select("anchor", "call_id").join(named, "call_id").select(F.col("anchor").alias("event"), "read_name").distinct(), "complex-reads")
    support = reads.groupBy("event").agg(F.count("*").cast("double").alias("support"))
    ends = met.groupBy(F.col("anchor").alias("event")).agg(F.first("chrom").alias("chrom"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.avg("mapq").cast("int").alias("mapq"), F.transform(F.array_sort(F.collect_list(F.struct("n", "sv_type"))), lambda x: x["sv_type"]).alias("components"))
    return ends.join(support, "event").select("event", "chrom", "start", "stop", (F.col("stop") - F.col("start")).alias("size"), "support", "mapq", "components"), reads
