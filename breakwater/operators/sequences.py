"""Operators on rows in position order. A key may hold a third of all rows: every key is cut into ranges or bins of positions, each one task's work,
and what it needs from those before it (its predecessor's last row, how many groups began before) comes from one summary row each."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

BIN = 1_000_000


def _bins(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.floor(F.col(pos) / width).cast("bigint"))


def chain(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str], carry: Sequence[str], breaks: Callable[[Column], Column], out: str = "cluster") -> DataFrame:
    """Adds `out`: the number of the row's group among those of its key, from 1, in the order (pos, *ties). A row begins a group if it
    has no predecessor or breaks(predecessor) holds; the predecessor is a struct of pos and the columns `carry`.

    Rows are dealt into ranges of equal size in the order (keys, pos, *ties); windows over a range count its groups. A range's first row is compared with
    the row before it afterwards, and groups that began in earlier ranges are added, from a table of one row a range. The rows are stored in between, in
    the shared folder, as a second run could deal them otherwise."""
    cols = list(dict.fromkeys([pos, *carry]))
    order = list(dict.fromkeys([*keys, pos, *ties]))
    given = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    here = Window.partitionBy("_part").orderBy(*order)
    rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rows = rows.withColumns({"_before": F.lag(F.struct(given.alias("key"), F.struct(*cols).alias("cols"))).over(here), "_end": F.lead(F.lit(1)).over(here).isNull()})
    same = F.col("_before").isNotNull() & F.col("_before.key").eqNullSafe(given)
    new = ~same | F.coalesce(breaks(F.col("_before.cols")), F.lit(False))
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_first": F.col("_before").isNull(), "_new": new.cast("bigint")}).withColumn("_local", F.sum("_new").over(local))
    rows = stored(rows.drop("_before", "_new"), "chain")
    heads = rows.where("_first").select("_part", *df.columns)  # a row a range, like the next
    tails = rows.where("_end").select("_part", F.col("_local").alias("_n"), F.struct(given.alias("key"), F.struct(*cols).alias("cols")).alias("_last"))
    parts = tails.join(heads, "_part").withColumn("_prior", F.lag("_last").over(Window.orderBy("_part")))
    goes_on = F.col("_prior").isNotNull() & F.col("_prior.key").eqNullSafe(given)
    joins = goes_on & ~F.coalesce(breaks(F.col("_prior.cols")), F.lit(False))
    states = parts.select("_part", "_n", F.col("_last.key").eqNullSafe(given).alias("whole"), goes_on.alias("on"), joins.alias("joins")).orderBy("_part").collect()
    offsets, running = [], 0
    for x in states:
        offset = (running - x["joins"]) if x["on"] else 0
        offsets.append((x["_part"], offset))
        running = x["_n"] + (offset if x["whole"] else 0)
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset bigint").join(heads.select("_part", given.alias("_key")), "_part")
    added = F.col("_local") + F.when(F.col("_key").eqNullSafe(given), F.col("_offset")).otherwise(0)
    return rows.join(F.broadcast(table), "_part").withColumn(out, added.cast("bigint")).select(*df.columns, out)


def key_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Cuts key-sorted batches between keys: a table holds all rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cols = [batch[k].to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if held and a < b and any(held[-1][k][0] != batch[k][a] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def merge(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop", pad: int = 0, label: str | None = None, width: int = BIN) -> DataFrame:
    """Intervals of a key joined while the next starts within pad after all before it: keys, start, stop, n, and of the labels the only one, or `repeat`."""
    binned = _bins(df, start, width)
    local = Window.partitionBy(*keys, "_bin").orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    far = binned.groupBy(*keys, "_bin").agg(F.max(stop).alias("_far")).withColumn("_reached", F.max("_far").over(over)).drop("_far")
    rows = binned.withColumn("_local", F.max(stop).over(local)).join(far, [*keys, "_bin"])
    rows = rows.withColumn("_reach", F.greatest("_local", "_reached"))
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + pad)).cast("bigint"))
    counts = rows.groupBy(*keys, "_bin").agg(F.sum("_new").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    upto = Window.partitionBy(*keys, "_bin").orderBy(start, stop).rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.join(counts, [*keys, "_bin"]).withColumn("_group", F.col("_offset") + F.sum("_new").over(upto))
    aggs = [F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n")]
    if label:
        aggs.append(F.when(F.min(label) == F.max(label), F.min(label)).otherwise("repeat").alias(label))
    return grouped.groupBy(*keys, "_group").agg(*aggs).drop("_group")


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Adds `next`: the struct of cols of the row after this one within its key, for keys of few rows (the segments of a read)."""
    return df.withColumn("next", F.lead(F.struct(*cols)).over(Window.partitionBy(*keys).orderBy(*order)))


def anchored(df: DataFrame, key: str, pos: str, span: int, out: str = "anchor") -> DataFrame:
    """Adds `out`: the anchor of the row's window. The first position of a key is an anchor; a window holds all rows up to span after its
    anchor, and the first row beyond is the next anchor. Gaps over span always end a window, so islands between them are folded apart, over
    their distinct positions as a stream of rows: no island is held in memory."""
    places = df.select(key, pos).where(F.col(pos).isNotNull()).distinct()
    islands = chain(places, [key], pos, [], [], lambda before: F.col(pos) - before[pos] > span, "_island")
    schema = islands.select(key, pos).schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ") + f", {out} bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor = None, 0
        for pdf in batches:
            anchors = []
            for k, island, p in zip(pdf[key].tolist(), pdf["_island"].tolist(), pdf[pos].tolist(), strict=True):
                if now != (k, island) or p - anchor > span:
                    now, anchor = (k, island), p
                anchors.append(anchor)
            yield pd.DataFrame({key: pdf[key], pos: pdf[pos], out: pd.Series(anchors, dtype="int64")})

    dealt = islands.repartition(key, "_island").sortWithinPartitions(key, "_island", pos)
    found = dealt.mapInPandas(fold, schema)
    return df.join(found, [key, pos])


def numbered(df: DataFrame, key: str, pos: str, ties: Sequence[str], out: str = "number", width: int = BIN) -> DataFrame:
    """Adds `out`: the row's place, from 1, in the global order (key, pos, *ties). Bins of positions are sorted apart and their sizes added up."""
    binned = _bins(df, pos, width)
    sizes = binned.groupBy(key, "_bin").agg(F.count("*").alias("_n"))  # one row a bin
    before = Window.orderBy(key, "_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), "_offset")
    nth = F.row_number().over(Window.partitionBy(key, "_bin").orderBy(pos, *ties))
    rows = binned.withColumn("_nth", nth).join(sizes, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bin").eqNullSafe(F.col("_b")))
    return rows.withColumn(out, F.col("_offset") + F.col("_nth")).drop("_bin", "_k", "_b", "_offset", "_nth")
