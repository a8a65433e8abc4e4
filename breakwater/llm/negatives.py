"""Operator 12: hard negatives of anchors, by a kNN join over a Voronoi partition.

Vectors are whole numbers, floor(256 x). A coordinate more, which brings every candidate to one norm (and is 0 for anchors), turns the largest inner product
into the nearest point: d^2 = |a|^2 + M^2 - 2 a.s. Pivots, a bounded sample of the vectors, part the candidates into cells of those nearest to
each; a cell's row has its size and its members' least and largest distance from the pivot.

Anchors are dealt into groups of about GROUP by their own cells. Sizes and largest distances bound how far away an anchor's k-th
neighbour can be at most; the triangle inequality then tells which cells, and which rings of them, can hold it, and only these rows are
replicated to the group. There they meet its anchors exactly, as a stream in parts of about PART rows, so neither a hot cell nor a hot group is one
task; each part passes on k rows of an anchor, and the parts are merged.

The join runs twice: for an anchor's positives (its label, the nearest), and for the negatives (other labels, within the band of scores that
its positives allow). Bounds are widened by more than floating point can lose, and inner products are exact: recall is 1.

Rows of one label and vector differ by id alone, so of these only the k + 1 smallest ids can be in a result; the others stay anchors but
leave the candidates, and a vector that a third of the rows share is no hot spot.

Edge cases: rows with a null id, label or vector, or a null or non-finite component (also once multiplied by 256), take no part; equal rows are one row;
rows with an anchor's id are not its candidates, also where one id has several vectors, each of which is an anchor; vectors of different lengths never
meet; ties go to the smaller vec_id; fewer rows than asked for are all returned; a negative positive_score allows no negative; scores beyond
a long are held at its ends; an empty table gives no rows; only vec_id, embedding and label are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, key_runs, stored

GROUP, PART = 512, 65_536  # anchors of a group, candidates of a part
PIVOT_BYTES = 32 << 20  # pivots are the square root of the rows in number, and within this size in all
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
ROUTE = "grp string, cell int, low double, high double, n long"
MET = "akey string, place int, vec_id long, score long"


@dataclass
class Space:
    """What a task needs of the geometry: width of vectors, largest squared norm, pivots, whether doubles hold all inner products exactly."""

    width: int
    square: float
    pivots: np.ndarray

    @property
    def exact(self) -> bool:
        return self.square < 2.0**52

    @property
    def slack(self) -> float:
        return 1e-5 * (1 + self.square**0.5)

    def whole(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """Rows of whole numbers as doubles, padded with zeros to the width."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(sizes), self.width))
        out[np.arange(self.width) < sizes[:, None]] = np.floor(256 * np.asarray(column.flatten(), np.float64))
        return out

    def raised(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))
        return np.column_stack([x, more])

    def away(self, x: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """Distances of raised rows from pivots."""
        p = self.pivots if cells is None else self.pivots[cells]
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0))


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label, embedding, dim of the rows that take part, each once, with the labels changed as agreed."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256) == float("inf"))
    key, label = F.col("vec_id").cast("bigint"), F.col("label")
    rows = df.where(key.isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    changed = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label).cast("bigint")
    return rows.select(key.alias("vec_id"), changed.alias("label"), "embedding", F.size("embedding").alias("dim")).distinct()


def _space(rows: DataFrame) -> Space | None:
    times = lambda x: x.cast("double") * 256
    whole = lambda x: F.when(F.abs(times(x)) < 2.0**52, F.floor(times(x)).cast("double")).otherwise(times(x))
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + whole(x) * whole(x))
    n, width, most = rows.agg(F.count("*"), F.max("dim"), F.max(square)).first()
    if not n:
        return None
    out = Space(width, most, np.zeros((1, width + 1)))
    k = max(1, min(int(np.ceil(n**0.5)), PIVOT_BYTES // (8 * (width + 1))))
    chosen = rows.select("embedding").orderBy(F.xxhash64("embedding")).limit(k).toArrow()
    p = np.unique(out.raised(out.whole(chosen["embedding"]), False), axis=0)
    # From each pivot to the nearest one left: cells of near numbers are near each other.
    order, left = [0], np.ones(len(p), bool)
    left[0] = False
    while left.any():
        d = ((p - p[order[-1]]) ** 2).sum(1)
        order.append(int(np.where(left, d, np.inf).argmin()))
        left[order[-1]] = False
    out.pivots = p[order]
    return out


def _in_cells(rows: DataFrame, space: Space, anchors: bool) -> DataFrame:
    """With cell and away, the nearest pivot and the distance from it."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cells, aways = space.raised(space.whole(batch["embedding"]), anchors), [], []
            for at in range(0, len(x), 1024):
                d = space.away(x[at : at + 1024])
                cells.append(d.argmin(1))
                aways.append(d.min(1))
            if len(x):
                yield batch.append_column("cell", pa.array(np.concatenate(cells), pa.int32())).append_column("away", pa.array(np.concatenate(aways)))

    return rows.mapInArrow(of, schema + ", cell int, away double")


def _groups(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """With grp: about GROUP anchors of equal keys and near cells. Cells are laid end to end, and an anchor has a place by chance within its cell."""
    earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = anchors.groupBy(*keys, "cell").agg(F.count("*").alias("_size"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    place = F.floor((F.col("_before") + F.pmod(F.xxhash64("akey"), F.col("_size"))) / GROUP)
    return anchors.join(cells, [*keys, "cell"]).withColumn("grp", F.concat_ws(":", *keys, place)).drop("_size", "_before")


def _routes(anchors: DataFrame, cells: DataFrame, keys: list[str], space: Space, k: int) -> DataFrame:
    """grp, cell, low, high, n and the keys: which cells a group needs, and which distances from their pivots. anchors: with grp, own (rows of their id
    among the candidates) and near, far (distances between which candidates can serve; null far: up to the k-th neighbour)."""
    stats = cells.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
    names = anchors.select("grp", *keys).distinct()
    both = anchors.select("grp", F.lit(0).alias("side"), "embedding", "own", "near", "far").unionByName(names.join(stats, keys).select("grp", F.lit(1).alias("side"), "cell", "n", "least", "most"), allowMissingColumns=True)

    def needed_cells(run: pa.Table) -> pa.RecordBatch | None:
        side = run["side"].to_numpy()
        who, what = run.filter(pa.array(side == 0)), run.filter(pa.array(side == 1))
        if not who.num_rows or not what.num_rows:
            return None
        cell, n, least, most = (what[c].to_numpy() for c in ("cell", "n", "least", "most"))
        d = space.away(space.raised(space.whole(who["embedding"]), True), cell)
        near, far, own = who["near"].to_numpy(), np.array(who["far"].to_pylist(), float), who["own"].to_numpy()
        for i in np.flatnonzero(np.isnan(far)):
            order = np.argsort(d[i] + most)
            enough = np.searchsorted(np.cumsum(n[order]), k + own[i])
            far[i] = (d[i] + most)[order[enough]] if enough < len(order) else np.inf
        far += space.slack
        low = np.maximum(d - far[:, None], near[:, None] - space.slack - d)
        high = d + far[:, None]
        needed = (low <= most) & (high >= least)
        use = needed.any(0)
        if not use.any():
            return None
        low, high = np.where(needed, low, np.inf).min(0)[use], np.where(needed, high, -np.inf).max(0)[use]
        names = pa.array([run["grp"][0].as_py()] * len(low), pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(cell[use], pa.int32()), pa.array(low), pa.array(high), pa.array(n[use], pa.int64())], names=["grp", "cell", "low", "high", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "grp"):
            grp = run["grp"].to_numpy()
            for at, size in zip(*np.unique(grp, return_index=True, return_counts=True)[1:], strict=True):
                found = needed_cells(run.slice(at, size))
                if found:
                    yield found

    found = both.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(of, ROUTE)
    return found.join(names, "grp")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k largest numbers of each row above -inf; of equal ones the first."""
    if scores.shape[1] > k:
        last = np.partition(scores, -k, axis=1)[:, -k, None]
        above = scores > last
        level = (scores == last) & (last > -np.inf)
        return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True))))
    return np.nonzero(scores > -np.inf)


class Meeting:
    """The anchors of a group and the candidates that served them best so far. bands: score limits of each place of an anchor's result, or none."""

    def __init__(self, rows: list[pa.Table], space: Space, k: int, bands: bool) -> None:
        t = pa.concat_tables(rows)
        self.space, self.k, self.bands = space, k, bands
        self.keys, self.ids, self.dims, self.labels = t["akey"].to_pylist(), t["vec_id"].to_numpy(), t["dim"].to_numpy(), t["label"].to_numpy()
        self.x, self.limits = space.whole(t["embedding"]), [x or [] for x in t["scores"].to_pylist()]
        self.heaps: dict[tuple[int, int], list] = {}

    def put(self, i: int, place: int, score: int, key: int) -> None:
        heap = self.heaps.setdefault((i, place), [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -key))
        elif (score, -key) > heap[0]:
            heapq.heapreplace(heap, (score, -key))

    def meet(self, t: pa.Table) -> None:
        """Candidates in the order of their ids."""
        ids, dims, labels, x = t["vec_id"].to_numpy(), t["dim"].to_numpy(), t["label"].to_numpy(), self.space.whole(t["embedding"])
        fits = (self.dims[:, None] == dims) & (self.ids[:, None] != ids) & ((self.labels[:, None] != labels) == self.bands)
        if not self.space.exact:
            return self._slowly(ids, x, fits)
        scores = np.where(fits, self.x @ x.T, -np.inf)
        if not self.bands:
            for i, j in zip(*_best(scores, self.k), strict=True):
                self.put(i, 0, int(scores[i, j]), int(ids[j]))
            return None
        for place in range(max(map(len, self.limits))):
            top = np.array([float(s[place]) if len(s) > place else -1.0 for s in self.limits])[:, None]
            inside = np.where((80 * top <= 100 * scores) & (scores <= top), scores, -np.inf)
            for i, j in zip(*_best(inside, self.k), strict=True):
                self.put(i, place, int(inside[i, j]), int(ids[j]))
        return None

    def _slowly(self, ids: np.ndarray, x: np.ndarray, fits: np.ndarray) -> None:
        """In Python's whole numbers, where doubles don't hold the products."""
        mine, theirs = ([[int(v) for v in row] for row in m] for m in (self.x, x))
        for i, j in zip(*np.nonzero(fits), strict=True):
            score = sum(a * b for a, b in zip(mine[i], theirs[j], strict=True))
            for place, top in enumerate(self.limits[i] if self.bands else [score]):
                if not self.bands or 80 * top <= 100 * score <= 100 * top:
                    self.put(i, place, score, int(ids[j]))

    def rows(self) -> pa.RecordBatch:
        found = [(self.keys[i], place, -key, min(max(score, LOWEST), HIGHEST)) for (i, place), heap in self.heaps.items() for score, key in heap]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([],) * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["akey", "place", "vec_id", "score"])


def _meetings(space: Space, k: int, bands: bool) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, now = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, side = np.asarray(batch["key"].to_pylist(), object), batch["side"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    if now:
                        yield now.rows()
                    key, waiting, now = keys[a], [], None
                if side[a] == 0:
                    waiting.append(table.slice(a, b - a))
                elif waiting or now:
                    now = now or Meeting(waiting, space, k, bands)
                    waiting = []
                    now.meet(table.slice(a, b - a))
        if now:
            yield now.rows()

    return of


def _join(anchors: DataFrame, cells: DataFrame, keys: list[str], space: Space, k: int, bands: bool) -> DataFrame:
    """akey, place, vec_id, score: at most k candidates of each place of each anchor from each part of its group."""
    grouped = stored(_groups(anchors, keys), "negatives-anchors")
    routes = _routes(grouped, cells, keys, space, k).withColumn("parts", F.ceil(F.sum("n").over(Window.partitionBy("grp")) / PART))
    routes = stored(routes, "negatives-routes")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    served = cells.join(routes, [*keys, "cell"]).where((F.col("away") >= F.col("low")) & (F.col("away") <= F.col("high")))
    served = served.select(F.concat_ws("#", "grp", part).alias("key"), F.lit(1).alias("side"), "vec_id", "label", "dim", "embedding")
    parts = routes.select("grp", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    asking = grouped.join(parts, "grp").select(F.concat_ws("#", "grp", "part").alias("key"), F.lit(0).alias("side"), "vec_id", "label", "dim", "embedding", "akey", "scores")
    both = asking.unionByName(served, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "side", "vec_id")
    out = stored(both.mapInArrow(_meetings(space, k, bands), MET), "negatives-met")
    discard(anchors.sparkSession, grouped, routes)
    return out


def _first(met: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor (a row whose id `every` divides) and each of
    its first positives, the first negatives that score at most as high and at least 0.8 times as high."""
    spark, none = df.sparkSession, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = stored(usable(df), "negatives-rows")
    space = _space(rows)
    if space is None:
        return spark.createDataFrame([], none)
    copies = Window.partitionBy("label", "embedding").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives, negatives) + 1).drop("copy")
    cells = stored(_in_cells(kept, space, False), "negatives-cells")
    akey = F.concat_ws(":", "vec_id", "label", F.hex(F.xxhash64("embedding")))
    anchors = _in_cells(rows.where(F.col("vec_id") % every == 0), space, True).withColumn("akey", akey).withColumn("own", F.count("*").over(Window.partitionBy("vec_id")))
    anchors = stored(anchors.withColumns({"near": F.lit(0.0), "far": F.lit(None).cast("double"), "scores": F.lit(None).cast("array<bigint>")}), "negatives-anchors")
    met = _join(anchors, cells, ["label", "dim"], space, positives, False)
    liked = stored(_first(met, ["akey"], positives).select("akey", "rank", F.col("vec_id").alias("positive_id"), "score"), "negatives-positives")
    # An anchor's band: from its best positive down to 0.8 of its last that is not below zero.
    bands = liked.where("score >= 0").groupBy("akey").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("r"), "score"))).alias("s"), F.max("score").alias("best"), F.min("score").alias("last"))
    total = F.lit(float(space.square)) + F.col("square")
    root = lambda s: F.sqrt(F.greatest(F.lit(0.0), total - 2 * s))
    whole = lambda x: F.floor(x.cast("double") * 256).cast("double")
    asked = anchors.drop("near", "far", "scores").join(bands, "akey").withColumn("square", F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + whole(x) * whole(x)))
    asked = asked.withColumns({"near": root(F.col("best").cast("double")), "far": root(F.col("last").cast("double") * 0.8), "scores": F.transform("s", lambda x: x["score"])}).drop("s", "best", "last", "square")
    met = _join(stored(asked, "negatives-asked"), cells, ["dim"], space, negatives, True)
    found = _first(met, ["akey", "place"], negatives)
    sides = liked.select("akey", (F.col("rank") - 1).alias("place"), "positive_id", F.col("score").alias("positive_score"))
    out = found.join(sides, ["akey", "place"]).select(F.split("akey", ":")[0].cast("bigint").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return out


ORACLE = """
WITH u AS (SELECT DISTINCT vec_id, cast(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(list_inner_product(cast(a.v AS DOUBLE[]), cast(b.v AS DOUBLE[])) AS BIGINT) AS score FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
