"""Joins of half-open intervals. Both sides are dealt into bins of positions, so the join is an equi-join on key and bin; a pair is kept only
in the first bin that both touch. Zero-length intervals count as one base. A hot key is spread over its bins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .sequences import key_runs

BIN = 20_000
PLACES = 100_000


def _stop(start: Column, stop: Column) -> Column:
    return F.greatest(stop, start + 1)


def _binned(df: DataFrame, name: str, start: str, stop: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width).cast("bigint"), F.floor((_stop(F.col(start), F.col(stop)) - 1) / width).cast("bigint")
    return df.withColumn(f"{name}first", first).withColumn(f"{name}bin", F.explode(F.sequence(first, last)))


def overlaps(left: DataFrame, right: DataFrame, key: str, closed: bool = False, width: int = BIN, bounds: tuple[str, str, str, str] = ("start", "stop", "start", "stop")) -> DataFrame:
    """Every pair of a left and a right row with one key whose intervals overlap, once. Columns of the right side are prefixed r_. With
    closed, a touching end counts too. Rows with a null bound meet none."""
    s, e, rs, re_ = bounds
    more = 1 if closed else 0
    left = left.where(F.col(key).isNotNull() & F.col(s).isNotNull() & F.col(e).isNotNull()).withColumn("_e", F.col(e) + more)
    right = right.where(F.col(key).isNotNull() & F.col(rs).isNotNull() & F.col(re_).isNotNull()).select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("r__e", F.col(f"r_{re_}") + more)
    a, b = _binned(left, "_a", s, "_e", width), _binned(right, "_b", f"r_{rs}", "r__e", width)
    met = a.join(b, (F.col(key) == F.col(f"r_{key}")) & (F.col("_abin") == F.col("_bbin")))
    real = (F.col(s) < _stop(F.col(f"r_{rs}"), F.col("r__e"))) & (_stop(F.col(s), F.col("_e")) > F.col(f"r_{rs}")) & (F.col("_abin") == F.greatest("_afirst", "_bfirst"))
    return met.where(real).drop("_afirst", "_abin", "_bfirst", "_bbin", "_e", "r__e")


def earlier(queries: DataFrame, points: DataFrame, key: str, pos: str, value: str, most: bool = False, width: int = PLACES) -> DataFrame:
    """queries with `value`: the sum (or the largest, with most) of the value of all points of their key at smaller positions; null without any. Positions are
    cut into bins, and what a bin needs from those before it comes from one row a bin: work grows with rows, not with pairs."""
    total = F.max if most else F.sum
    plus = (lambda a, b: F.greatest(a, b)) if most else (lambda a, b: F.coalesce(a + b, a, b))
    nothing = queries.select("*", F.lit(None).cast("bigint").alias("_v"), F.lit(0).alias("_kind"))
    both = nothing.unionByName(points.select(key, pos, F.col(value).cast("bigint").alias("_v"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    both = both.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).withColumn("_bin", F.floor(F.col(pos) / width).cast("bigint"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    bins = both.groupBy(key, "_bin").agg(total("_v").alias("_v")).select(key, "_bin", total("_v").over(before).alias("_far"))
    upto = Window.partitionBy(key, "_bin").orderBy(pos, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_near", total("_v").over(upto)).where("_kind = 0").join(bins, [key, "_bin"])
    return local.select(*queries.columns, plus(F.col("_near"), F.col("_far")).alias(value))


def covered(left: DataFrame, right: DataFrame, key: str, ids: Sequence[str], closed: bool = False) -> DataFrame:
    """left with `covered`: whether any right interval overlaps the row. ids name a row; rows with equal ids must have equal intervals. Some interval overlaps
    if, of those that begin before the row's end, the farthest goes beyond its start: no pairs are made."""
    more = 1 if closed else 0
    last = lambda: _stop(F.col("start"), F.col("stop") + more)
    real = F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull()
    asked = left.where(real).select(*dict.fromkeys([*ids, key]), F.col("start").alias("_start"), last().alias("_at")).distinct()
    points = right.where(real).select(key, F.col("start").alias("_at"), last().alias("_reach"))
    hit = earlier(asked, points, key, "_at", "_reach", most=True).where(F.col("_reach") > F.col("_start")).select(*ids).distinct().withColumn("covered", F.lit(True))
    return left.join(hit, list(ids), "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


class Contained:
    """Counts of whole-number intervals within queries, for all queries at once: intervals are sorted by their begin, and every block of 2^k of
    them by their end, so a query is a search in one block of each size."""

    def __init__(self, first: np.ndarray, last: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        self.first, self.top = first[order], int(last.max(initial=0)) + 2
        size = 1 << max(0, int(np.ceil(np.log2(max(1, len(first))))))
        self.level = np.full(size, self.top - 1, np.int64)
        self.level[: len(last)] = last[order]

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many intervals begin at low or later and end at high or earlier."""
        begin, total, size, level = np.searchsorted(self.first, low), np.zeros(len(low), np.int64), 1, self.level
        wanted = np.minimum(high, self.top - 2)
        while True:
            odd = (begin & 1) == 1 if size < len(level) else begin == 0  # blocks of this size that the rest of the intervals begins with
            block = begin[odd]
            keyed = level + np.arange(len(level)) // size * self.top
            total[odd] += np.searchsorted(keyed, block * self.top + wanted[odd], "right") - block * size
            if size >= len(level):
                return total
            begin = (begin + 1) >> 1
            size *= 2
            level = np.sort(level.reshape(-1, size), axis=1).ravel()


COUNTED = "id bigint, key bigint, low bigint, high bigint, n bigint"
ASKED_LOW, ASKED_HIGH, BY_X, BY_Y = range(4)


def contained(queries: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """id, n: parts, to be summed up by id, of how many points of a query's key have x >= low and y <= high, less those that also have z <= high. queries: id,
    key, low, high; points: key, x, y, z; all whole numbers, of which z may be null. Each query has a part.

    Places are cut into blocks of `width`. The block of low counts the points with x in it, the block of high those with y in it and x beyond the block of low; the others lie in
    blocks between, which are counted in a grid of one row a pair of blocks. A query goes to two tasks and a point to three at most: work grows with rows, not with pairs."""
    block = lambda c: F.floor(F.col(c) / width).cast("bigint")

    def row(at: str, kind: int, *cols: str | int) -> Column:
        return F.struct(block(at).alias("block"), F.lit(kind).alias("kind"), *((F.lit(x) if isinstance(x, int) else F.col(x)).cast("bigint").alias(n) for n, x in zip("abc", cols, strict=True)))

    asked = queries.select("key", F.inline(F.array(row("low", ASKED_LOW, "id", "low", "high"), row("high", ASKED_HIGH, "id", "low", "high"))))
    beyond = [F.when(block(c) != block("x"), row(c, BY_Y, "x", c, sign)) for c, sign in (("y", 1), ("z", -1))]
    dealt = asked.unionByName(points.select("key", F.inline(F.array_compact(F.array(row("x", BY_X, "x", "y", "z"), *beyond)))))
    counted = stored(dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_block_counts(width), COUNTED), "contained")
    known = counted.where("id IS NOT NULL AND key IS NOT NULL")
    grid = counted.where("id IS NULL").drop("id").unionByName(known.select("key", "low", "high", F.lit(None).cast("bigint").alias("n")).distinct())
    between = grid.repartition("key").sortWithinPartitions("key").mapInArrow(_grid_sums, "key bigint, low bigint, high bigint, n bigint")
    return counted.where("id IS NOT NULL").select("id", "n").unionByName(known.drop("n").join(between, ["key", "low", "high"]).select("id", "n"))


def _within(x: np.ndarray, y: np.ndarray, sign: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros(len(low), np.int64)
    for s in (1, -1):
        if (k := sign == s).any():
            least = y[k].min()
            total += s * Contained(x[k], y[k] - least).within(low, np.maximum(high - least, -1))
    return total


def _block_counts(width: int) -> Callable:
    """Parts of queries (those by low with key and blocks), and rows of the grid, which have no id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "key", "block"):
            yield from counts(t)

    def counts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, block, kind = t["key"][0].as_py(), t["block"][0].as_py(), t["kind"].to_numpy()
        a, b, c, third = t["a"].to_numpy(), t["b"].to_numpy(), t["c"].fill_null(0).to_numpy(), t["c"].is_valid().to_numpy()
        near, far, ask, last = (kind == k for k in (BY_X, BY_Y, ASKED_LOW, ASKED_HIGH))
        twice = near & third
        x, y, sign = np.concatenate([a[near], a[twice]]), np.concatenate([b[near], c[twice]]), np.repeat([1, -1], [near.sum(), twice.sum()])
        to = y // width

        def out(i: np.ndarray | None, k: int | None, low: np.ndarray | None, high: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            cols = [i, None if k is None else np.full(len(n), k), low, high, n]
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()) if v is None else pa.array(v, pa.int64()) for v in cols], names=["id", "key", "low", "high", "n"])

        yield out(a[ask], key, b[ask] // width, c[ask] // width, _within(x, y, sign, b[ask], c[ask]))
        inside = to == block
        x2, y2, sign2 = np.concatenate([a[far], x[inside]]), np.concatenate([b[far], y[inside]]), np.concatenate([c[far], sign[inside]])
        n = _within(x2, y2, sign2, (b[last] // width + 1) * width, c[last])
        yield out(a[last][n != 0], None, None, None, n[n != 0])
        cells, nth = np.unique(to, return_inverse=True)
        n = np.bincount(nth, sign, len(cells)).astype(np.int64)
        yield out(None, key, np.full(len(cells), block), cells, n)

    return of


def _grid_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a key's pairs of blocks that are asked for, what lies in blocks beyond the first and before the second."""
    for t in key_runs(batches, "key"):
        low, high, n, cell = t["low"].to_numpy(), t["high"].to_numpy(), t["n"].fill_null(0).to_numpy(), t["n"].is_valid().to_numpy()
        (rows, r), (cols, c) = np.unique(low[cell], return_inverse=True), np.unique(high[cell], return_inverse=True)
        grid = np.zeros((len(rows) + 1, len(cols) + 1), np.int64)
        np.add.at(grid, (r, c + 1), n[cell])
        grid = np.cumsum(np.cumsum(grid[::-1], axis=0)[::-1], axis=1)
        low, high = low[~cell], high[~cell]
        n = grid[np.searchsorted(rows, low, "right"), np.searchsorted(cols, high, "left")]
        k = n != 0
        yield pa.RecordBatch.from_arrays([pa.repeat(t["key"][0], int(k.sum())), *(pa.array(v[k]) for v in (low, high, n))], names=["key", "low", "high", "n"])
