"""CIGAR strings as columns. A row's operations are folded in place: no explode and no shuffle to find positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADVANCE = ("M", "=", "X", "D", "N")
ALIGNED = ("M", "=", "X")
SUMMED = 2**20
LISTED = 1024


def operations(cigar: Column) -> Column:
    """array<struct<n bigint, op string>>; null and * have none."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment spans."""
    return F.aggregate(operations(cigar), F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["op"].isin(*ADVANCE), x["n"]).otherwise(F.lit(0).cast("bigint")))


def query_length(cigar: Column) -> Column:
    """Bases of the read, clipped ones left out."""
    return F.aggregate(operations(cigar), F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["op"].isin("M", "=", "X", "I"), x["n"]).otherwise(F.lit(0).cast("bigint")))


def events(cigar: Column, start: Column, min_insertion: int, min_deletion: int) -> Column:
    """array<struct<op string, at bigint, n bigint>>: insertions and deletions of at least those lengths with their reference positions."""
    empty = F.expr("cast(array() as array<struct<op string, at bigint, n bigint>>)")
    first = F.struct(start.cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = ((x["op"] == "I") & (x["n"] >= min_insertion)) | ((x["op"] == "D") & (x["n"] >= min_deletion))
        moved = acc["at"] + F.when(x["op"].isin(*ADVANCE), x["n"]).otherwise(F.lit(0).cast("bigint"))
        found = F.array(F.struct(x["op"].alias("op"), acc["at"].alias("at"), x["n"].alias("n")))
        return F.struct(moved.alias("at"), F.when(hit, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(operations(cigar), first, step, lambda acc: acc["out"])


def parsed(cigar: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of CIGAR strings all operations at once: the row, the letter's code and the length of each. Nulls and what is no operation have none.
    For whole batches this takes a fraction of what folding every row as an array does."""
    texts = pc.fill_null(cigar.cast(pa.large_string()), "")
    size = np.asarray(pc.binary_length(texts), np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("ascii", "replace"), np.uint8)
    ends = np.cumsum(size)
    ops = np.flatnonzero(~((raw >= 48) & (raw <= 57)))
    digits = np.flatnonzero((raw >= 48) & (raw <= 57))
    of = np.searchsorted(ops, digits)
    row = np.searchsorted(ends, ops, "right")
    kept = of < len(ops)
    digits, of = digits[kept], of[kept]
    same = np.searchsorted(ends, digits, "right") == row[of] if len(ops) else np.zeros(0, bool)
    digits, of = digits[same], of[same]
    n = np.zeros(len(ops), np.int64)
    np.add.at(n, of, (raw[digits].astype(np.int64) - 48) * 10 ** np.minimum(ops[of] - digits - 1, 17))
    real = np.isin(raw[ops], np.frombuffer(b"MIDNSHP=X", np.uint8)) & (np.bincount(of, minlength=len(ops)) > 0)
    return row[real], raw[ops][real], n[real]


def _is(code: np.ndarray, letters: tuple[str, ...]) -> np.ndarray:
    return np.isin(code, [ord(x) for x in letters])


def with_span(df: DataFrame, cigar: str = "cigar", start: str = "start") -> DataFrame:
    """Adds span_stop: where the alignment ends on the reference; null without a start."""
    schema = T.StructType([*df.schema.fields, T.StructField("span_stop", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, n = parsed(batch[cigar])
            length = np.bincount(row, np.where(_is(code, ADVANCE), n, 0), batch.num_rows).astype(np.int64)
            yield batch.append_column("span_stop", pc.add(batch[start].cast(pa.int64()), pa.array(length)))

    return df.mapInArrow(of, schema)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values summed up by equal keys, in the order of the first key, then the next; where all sums are zero there is none."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(k) != 0 for k in keys], axis=0)
    first = np.flatnonzero(new)
    values = [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]
    kept = np.any([v != 0 for v in values], axis=0)
    return [k[first][kept] for k in keys], [v[kept] for v in values]


def _listed(codes: dict, parts: list, key: pa.DataType, width: int) -> pa.RecordBatch:
    """The changes that a task holds, as rows of depth_events. parts: codes of keys, places, changes of reads and of depth."""
    code, at, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    (code, at), values = summed([code, at], values)
    bins = at // width
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(code) != 0) | (np.diff(bins) != 0)
    begins = np.flatnonzero(new)
    begins = np.flatnonzero((np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % LISTED == 0)
    gaps = np.diff(at, prepend=0)
    gaps[begins] = (at - bins * width)[begins]
    ends = pa.array(np.append(begins, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (gaps, *values)]
    return pa.RecordBatch.from_arrays([pa.array(list(codes), key).take(pa.array(code[begins])), pa.array(bins[begins]), *lists], names=["key", "bin", "gaps", "reads", "depth"])


def depth_events(df: DataFrame, width: int, most: int = SUMMED, key: str = "chrom", cigar: str = "cigar", start: str = "start", good: str = "good") -> DataFrame:
    """key, bin, gaps, reads, depth: what changes where along the reference. An alignment is one more read from its start to its end, and, if it is good, one more
    base over each of its blocks of bases; deletions and skips lie between them. Rows with a null key or start or without a length on the reference have no events.

    A task holds `most` changes, and the batch that goes beyond them, and sums them up by place. A row lists the sums of a bin of that width in order: at most LISTED
    places, the first as its distance from the bin's begin, others from the place before (see listed_places). A place may be in several rows."""
    lists = {c: T.ArrayType(T.IntegerType(), False) for c in ("gaps", "reads", "depth")}
    if not 0 < width < 2**31:
        raise ValueError("width must be below 2**31")
    # No column is null, so a join adds no filter and both its sides can read one exchange.
    schema = T.StructType([T.StructField(c, t, False) for c, t in ({key: df.schema[key].dataType, "bin": T.LongType()} | lists).items()])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, held = {}, [], 0
        for batch in batches:
            batch = batch.filter(pc.and_(batch[start].is_valid(), batch[key].is_valid()))
            row, code, n = parsed(batch[cigar])
            moved = np.where(_is(code, ADVANCE), n, 0)
            upto = np.cumsum(moved)
            length = np.bincount(row, moved, batch.num_rows).astype(np.int64)
            first = batch[start].to_numpy().astype(np.int64)
            at = first[row] + upto - (np.cumsum(length) - length)[row]  # where an operation ends
            block = _is(code, ALIGNED) & (n > 0) & np.asarray(pc.fill_null(batch[good], False))[row].astype(bool)
            rows = np.flatnonzero(length > 0)
            b, e, r = at[block] - n[block], at[block], row[block]
            one, none = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
            more, no = np.ones(len(r), np.int64), np.zeros(len(r), np.int64)
            keys = batch[key].dictionary_encode()
            known = np.array([codes.setdefault(k, len(codes)) for k in keys.dictionary.to_pylist()], np.int64)
            places = [rows, rows, r, r]
            columns = [[first[rows], (first + length)[rows], b, e], [one, -one, no, no], [none, none, more, -more]]
            parts.append((known[keys.indices.to_numpy()[np.concatenate(places)]], *(np.concatenate(c) for c in columns)))
            held += len(parts[-1][0])
            if held >= most:
                yield _listed(codes, parts, keys.type.value_type, width).rename_columns(schema.names)
                codes, parts, held = {}, [], 0
        if held:
            yield _listed(codes, parts, keys.type.value_type, width).rename_columns(schema.names)

    return df.mapInArrow(of, schema)


def listed_places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of depth_events: the places, counted from the bin's begin, and what changes there."""
    size = np.asarray(pc.list_value_length(batch["gaps"]), np.int64)
    gaps, reads, depth = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("gaps", "reads", "depth"))
    upto = np.append(0, np.cumsum(gaps))
    return upto[1:] - np.repeat(upto[np.cumsum(size) - size], size), reads, depth
