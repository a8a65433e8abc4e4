"""Operator 2: nearest neighbours by inner product, as a block matrix join.

Queries and candidates are dealt into blocks, and every query block meets every candidate block once: a cell. In a cell both sides are
quantised to int8 and multiplied as whole-number matrices, which gives every inner product with a bound of its error (Cauchy-Schwarz on
what quantisation took away). A pair survives if its upper bound reaches the k-th largest lower bound of its query; survivors are
recomputed from the original vectors in double precision, and each cell passes on k of each query. Heaps merge the cells' lists. The
bounds are strict, so the result is exact: recall is 1.

The blocks have at most about QUERY_BLOCK and CANDIDATE_BLOCK rows at any size, so cells are alike and a cell fits a task. A vector that a
third of the rows share is spread over the blocks by its id.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different lengths never meet; rows with the query's id are not its candidates; equal query rows are one query, and queries with one id
but different vectors are each answered; ties go to the smaller vec_id; fewer candidates than k are all returned; an empty table gives no
rows; only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_runs, stored

QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 2048, 16384, 128
FOUND = "query_key long, query_id long, vec_id long, score double"


def _matrix(rows: pa.Table) -> np.ndarray:
    column = rows["embedding"].combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(rows.num_rows, -1)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, the norm of what they stand for, and the norm of what they miss."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    meant = codes * scale[:, None]
    return codes, scale, np.linalg.norm(meant, axis=1), np.linalg.norm(x - meant, axis=1)


def _near_one(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times powers of two that bring their largest component to between 0.5 and 1, so that squares of small ones don't vanish; and what takes it back."""
    power = np.frexp(np.abs(x).max(1))[1]
    with np.errstate(over="ignore"):
        return np.ldexp(x, -power[:, None]), np.ldexp(1.0, power)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _cell(k: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, query_ids, ids = left["query_key"].to_numpy(), left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, x = _matrix(left), _matrix(right)
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(x):
            exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers a BLAS product keeps exact
            even, query_scale = _near_one(q)
            qc, qs, qn, qe = _quantised(even)
            even, back = _near_one(x)
            xc, xs, _, xe = _quantised(even)
            norm = np.linalg.norm(even, axis=1)
            tile = xc.astype(exact).T
            for at in range(0, len(q), STRIP):
                rows = slice(at, at + STRIP)
                with np.errstate(over="ignore", invalid="ignore"):
                    near = (qc[rows].astype(exact) @ tile).astype(np.float64) * qs[rows, None] * xs * back * query_scale[rows, None]
                    miss = ((qe[rows, None] * norm + qn[rows, None] * xe) * (1 + 1e-9) + 1e-12 * (qn[rows, None] + qe[rows, None]) * norm) * back * query_scale[rows, None] + 1e-322
                unbounded = ~np.isfinite(near + miss)  # beyond double precision: such pairs survive and are recomputed
                near[unbounded], miss[unbounded] = 0, np.inf
                own = query_ids[rows, None] == ids
                low = near - miss
                low[own] = -np.inf
                floor = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
                r, c = np.nonzero((near + miss >= floor[:, None]) & ~own)
                score = np.concatenate([np.zeros(0), *(_products(q[at + r[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(r), 65536))])
                score[np.isnan(score)] = -np.inf  # infinity less infinity: last
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                best = nth < k
                out.append((keys[at + r[best]], query_ids[at + r[best]], ids[c[best]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(cols, ["query_key", "query_id", "vec_id", "score"])

    return of


def _merge(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "query_key"):
            key, query, ids, score = (t[c].to_numpy() for c in ("query_key", "query_id", "vec_id", "score"))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            rows: list[tuple] = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                best = heapq.nsmallest(k, zip((-score[a:z]).tolist(), ids[a:z].tolist(), strict=True))
                rows += [(int(query[a]), n, i, -s) for n, (s, i) in enumerate(best, 1)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return of


def nearest(vectors: DataFrame, modulus: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product, for each row whose id is divisible by modulus."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    asks = F.pmod("vec_id", F.lit(modulus)) == 0
    rows = stored(rows.withColumn("width", F.size("embedding")), "neighbours")
    counts = rows.groupBy("width").agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("asked")).groupBy().agg(F.max("n"), F.max("asked")).first()
    down, across = (max(1, -(-(n or 0) // size)) for n, size in zip(counts, (CANDIDATE_BLOCK, QUERY_BLOCK), strict=True))

    def block(blocks: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    queries = rows.where(asks).withColumn("query_key", F.xxhash64("vec_id", "embedding")).dropDuplicates(["query_key"])
    cell = ["width", "across", "down"]
    left = queries.withColumn("across", block(across, 1)).withColumn("down", every(down))
    right = rows.withColumn("down", block(down, 2)).withColumn("across", every(across))
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), FOUND)
    return met.repartition("query_key").sortWithinPartitions("query_key").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
WHERE rank <= 20
"""
