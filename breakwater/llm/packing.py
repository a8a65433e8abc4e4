"""Operator 8: best-fit packing of documents into fixed-length sequences, planned on the histogram of lengths.

A document is its ids and an end id. Those longer than a sequence are cut into pieces of the full length, the first of which may be
shorter. Best-fit decreasing then runs over counts: at most `length` numbers (how many pieces have each length) reach the driver, however
many documents there are, and one step places all equal pieces that best-fit would treat alike. The plan says, for each length, which
ranks go to which sequences and offset; each piece looks its slot up by its rank within its length. Ranks are counted in buckets of a hash
of the id, as many as there are shuffle partitions, so that a length that a third of all pieces share is no task of its own. The plan is
sent to the tasks: its rows are bounded by the lengths (a few thousand for 1024), not by the pieces.

Edge cases: null and empty texts are a document of the end id alone; repeated rows are documents of their own; a null id stays null;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_vocabulary, encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, length: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; its ids too, if asked for."""
    tail = int(end).to_bytes(4, "little")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            rows: list[tuple] = []
            for k, i in enumerate(ids):
                data = encode(texts[k].as_py()) + tail
                n = len(data) // 4
                cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = data[4 * a : 4 * z]
                    rows.append((i, p, a, z - a, zlib.crc32(part), part))
            doc, piece, start, size, crc, raw = zip(*rows, strict=True) if rows else ((),) * 6
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], length: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, ranks, first sequence, offset): ranks first .. first + ranks - 1 of that
    length go to as many sequences from the first one on, at that offset. Sequences filled alike are one group, so that the work depends on
    the number of lengths and not on the counts."""
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    rooms: list[int] = []  # in ascending order
    following = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        if not 0 < size <= length:
            raise ValueError(f"a piece of {size} ids")
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = length, following, -(-left // (length // size))
                following += n
            each = room // size  # best-fit fills a sequence with equal pieces before it turns to the next
            full = min(n, left // each)
            if full:
                rows.extend((size, rank + k * full, full, first, length - room + k * size) for k in range(each))
            rank, left = rank + each * full, left - each * full
            put(room - each * size, first, full)
            if full < n:
                some = min(left, each)  # the last pieces, in one sequence
                for k in range(some):
                    rows.append((size, rank + k, 1, first + full, length - room + k * size))
                rank, left = rank + some, left - some
                if some:
                    put(room - some * size, first + full, 1)
                put(room, first + full + bool(some), n - full - bool(some))
    return rows


def _slots(planned: list[tuple[int, int, int, int, int]], length: int):
    """Gives each ranked piece its sequence and offset: the plan's row of its length with the greatest first rank that isn't beyond its own."""
    rows = np.array(sorted(planned), np.int64).reshape(-1, 5)
    starts = np.searchsorted(rows[:, 0], np.arange(length + 2))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(size), np.int64)
            for n in np.unique(size):
                mine = size == n
                at[mine] = starts[n] + np.searchsorted(rows[starts[n] : starts[n + 1], 1], rank[mine], "right") - 1
            out = [b.column(c) for c in b.schema.names if c != "rank"]
            out += [pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])]
            yield pa.RecordBatch.from_arrays(out, [*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    return of


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; with_ids adds the ids, so that a sequence is its pieces' ids by offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary or default_vocabulary(), length, end, id_col, text_col, with_ids), "packing-pieces")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = stored(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing-counts")
    sizes = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ordered = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(ordered)).join(before, ["length", "bucket"])
    kept = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *(["ids"] if with_ids else []), (F.col("before") + F.col("nth") - 1).alias("rank")]
    placed = PIECES.replace("length int", "length long") + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*kept).mapInArrow(_slots(plan(sizes, length), length), placed)
