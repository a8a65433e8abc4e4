"""Calls against a truth set: one-to-one matches of one type within a distance and a size ratio."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


STATES = "chrom string, sv_type string, truth_id bigint, call_id bigint, state string"
ROWS = "chrom string, sv_type string, real boolean, id bigint, start bigint, size bigint, other bigint, open boolean"
WIDTH = 1_000_000


def _pairs(t: pa.Table, c: pa.Table, distance: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of truth rows (sorted by start) and calls that are near enough and of like size, nearest first, then by ids."""
    ts, cs, tz, cz = t["start"].to_numpy(), c["start"].to_numpy(), np.maximum(np.abs(t["size"].to_numpy()), 1), np.maximum(np.abs(c["size"].to_numpy()), 1)
    low, high = np.searchsorted(ts, cs - distance), np.searchsorted(ts, cs + distance, "right")
    n = high - low
    j = np.repeat(np.arange(len(cs)), n)
    i = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    like = np.minimum(tz[i], cz[j]) / np.maximum(tz[i], cz[j]) >= ratio
    i, j = i[like], j[like]
    order = np.lexsort((c["id"].to_numpy()[j], t["id"].to_numpy()[i], np.abs(ts[i] - cs[j])))
    return i[order], j[order]


def _settled(distance: int, ratio: float, width: int, shift: int):
    """Pairs of a bin are taken nearest first. A pair is final only if no better pair of either row can lie beyond the bin's ends or hangs on one that
    does; such pairs leave their rows open."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _bins(batches):
            at = int(run["_bin"][0].as_py()) * width - shift
            real = np.asarray(run["real"], bool)
            t, c = run.filter(pa.array(real)), run.filter(pa.array(~real))
            inner = [(x["start"].to_numpy() - distance >= at) & (x["start"].to_numpy() + distance < at + width) for x in (t, c)]
            other, held = [np.full(len(x), -1) for x in inner], [~x for x in inner]
            waiting = []
            for i, j in zip(*(x.tolist() for x in _pairs(t, c, distance, ratio)), strict=True):
                if other[0][i] >= 0 or other[1][j] >= 0:
                    continue
                if held[0][i] or held[1][j]:
                    held[0][i] = held[1][j] = True
                    waiting.append((i, j))
                else:
                    other[0][i], other[1][j] = j, i
            still = [~x for x in inner]
            for i, j in waiting:
                if other[0][i] < 0 and other[1][j] < 0:
                    still[0][i] = still[1][j] = True
            for mine, theirs, met, on in ((t, c, other[0], still[0]), (c, t, other[1], still[1])):
                ids = np.where(met >= 0, theirs["id"].to_numpy()[met] if theirs.num_rows else 0, 0)
                out = mine.drop_columns(["_bin", "_key"]).append_column("other", pa.array(ids, mask=met < 0)).append_column("open", pa.array(on & (met < 0)))
                yield from out.to_batches()

    return of


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each run of equal _key."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        key = rest["_key"].to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for a, b in itertools.pairwise(cuts):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def match(truth: DataFrame, calls: DataFrame, distance: int = 500, ratio: float = 0.7, width: int = WIDTH) -> DataFrame:
    """chrom, sv_type, truth_id, call_id, state (TP, FN, FP). Both sides: id (unique on its side), chrom, sv_type, start, size; rows without start or size take no
    part. Nearer pairs are taken first, ties by truth id, then call id.

    Rounds: chromosomes are cut into bins, and a bin settles all pairs that don't hang on a row near its ends. The next round cuts elsewhere, and only
    rows still open are in it: their number falls with every round, and nothing longer than a bin is in one task."""
    width = max(width, 8 * distance + 8)
    cols = ["chrom", "sv_type", "real", "id", "start", "size"]
    both = truth.withColumn("real", F.lit(True)).select(cols).unionByName(calls.withColumn("real", F.lit(False)).select(cols))
    rows = both.where("start IS NOT NULL AND size IS NOT NULL").withColumns({c: F.col(c).cast("bigint") for c in ("id", "start", "size")})
    done, turn = [], 0
    while True:
        shift = turn % 2 * (width // 2)
        binned = rows.select(*cols).withColumn("_bin", F.floor((F.col("start") + shift) / width).cast("bigint")).withColumn("_key", F.xxhash64("chrom", "sv_type", "_bin"))
        dealt = binned.repartition("chrom", "sv_type", "_bin").sortWithinPartitions("_key", "chrom", "sv_type", "_bin", "start", "id")
        now = stored(dealt.mapInArrow(_settled(distance, ratio, width, shift), ROWS), "matches")
        done.append(now.where("NOT open"))
        rows = now.where("open")
        turn += 1
        if rows.isEmpty():
            break
    every = reduce(DataFrame.unionByName, done)
    state = F.when(~F.col("real"), "FP").when(F.col("other").isNull(), "FN").otherwise("TP")
    rows = every.where(F.col("real") | F.col("other").isNull())
    return rows.select("chrom", "sv_type", F.when(F.col("real"), F.col("id")).alias("truth_id"), F.when(F.col("real"), F.col("other")).otherwise(F.col("id")).alias("call_id"), state.alias("state"))


def summary(states: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 in one row; shares of nothing are 0."""
    n = states.agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s.lower()) for s in ("TP", "FP", "FN")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
