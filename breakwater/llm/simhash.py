"""Operator 10: near-duplicates by SimHash, found through Golay-code fuzzy hash keys.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 values of the text's word shingles. Two fingerprints link at
`max_bits` = 3 or fewer differing bits; the components of that relation are the groups of near-duplicates.

Every link is found. The fingerprint is cut into segments A, B, C of 22, 21, 21 bits, and at most three errors fall on them so that
either (Z) one segment has none and another at most one, or (T) each has exactly one. For Z the key of an ordered pair of segments (i, j)
is all of segment i and a Golay codeword index for segment j; for T it is the indices of A and B and the parities of A, B, C. Each
fingerprint is indexed under the codeword nearest to its segment (7 keys) and looks under the up to six codewords near it: a segment
with at most one error is then met. In T the looked-up parities are the opposite ones, and only fingerprints of even weight look, as
three errors always join an even and an odd one. Pairs that meet are verified by their exact distance.

Equal fingerprints are one node, so exact copies cost one node however many there are. In one key's run only a spanning forest of its
links is passed on once links outnumber members fourfold; keys with over HOT_KEY indexed fingerprints are dealt over several tasks.

Edge cases: null and empty texts, and texts of white space only, have fingerprint zero and link like any other; texts of fewer words
than a shingle are one shingle; repeated rows each give a row; a null id gives a row whose component is the smallest id of the group
(null if the group has none); only the id and text columns are read, so others may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, discard, key_runs, salted_join, stored, unused
from .components import components
from .golay import codeword_index, near_codewords

SEGMENTS = ((0, 22), (22, 21), (43, 21))
ORDERED = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
HOT_KEY = 4096
BLOCK = 1024


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all runs of `words` words, repeats included; of all words if they are fewer; nothing for no words."""
    found = ascii_words(text)
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(found) - words + 1)
    ends = ends[-k:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:k].tolist(), ends.tolist(), strict=True)), "<u8", k)


def simhash(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a long text's bits are unpacked a piece at a time
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [simhash(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, fingerprint long")


def _keys(marks: np.ndarray, index: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints are indexed or looked up, and the row of each."""
    bits = marks.astype("<i8").view("<u8")
    seg = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    odd = [np.bitwise_count(s) & 1 for s in seg]
    rows, keys, n = [], [], len(marks)
    if index:
        code = [codeword_index(s) for s in seg]
        for f, (i, j) in enumerate(ORDERED):
            keys.append(f << 34 | seg[i] << 12 | code[j])
            rows.append(np.arange(n))
        keys.append(6 << 34 | code[0] << 15 | code[1] << 3 | odd[0] << 2 | odd[1] << 1 | odd[2])
        rows.append(np.arange(n))
    else:
        near = [near_codewords(s) for s in seg]
        for f, (i, j) in enumerate(ORDERED):
            code, real = near[j]
            keys.append((f << 34 | seg[i][:, None] << 12 | code)[real])
            rows.append(np.nonzero(real)[0])
        even = np.flatnonzero((odd[0] ^ odd[1] ^ odd[2]) == 0)
        (a, a_real), (b, b_real) = ((x[even], y[even]) for x, y in near[:2])
        flip = ((1 - odd[0]) << 2 | (1 - odd[1]) << 1 | (1 - odd[2]))[even]
        real = a_real[:, :, None] & b_real[:, None, :]
        keys.append((6 << 34 | a[:, :, None] << 15 | b[:, None, :] << 3 | flip[:, None, None])[real])
        rows.append(even[np.nonzero(real)[0]])
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(sides: tuple[bool, ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                marks = b.column(0).slice(at, 4096).to_numpy()
                for index in sides:
                    keys, rows = _keys(marks, index)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), not index)), pa.array(marks[rows])], ["key", "look", "fingerprint"])

    return of


def _forest(u: np.ndarray, v: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """The same links, or where they outnumber members fourfold, stars with the same components."""
    if len(u) <= 4 * members:
        return u, v
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _verify(max_bits: int):
    def linked(p: np.ndarray, i: np.ndarray) -> np.ndarray:
        d = np.bitwise_count((p ^ i).view("<u8"))
        return (d <= max_bits) & (d > 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "key"):
            key, look, mark = t["key"].to_numpy(), t["look"].to_numpy(zero_copy_only=False), t["fingerprint"].to_numpy()
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.append(start[1:], len(key))
            mid = start + np.add.reduceat(~look, start)  # a run has its indexed rows first
            pairs = (mid - start) * (end - mid)
            big = pairs > BLOCK * BLOCK
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, m, z in zip(start[big], mid[big], end[big], strict=True):
                for x in range(a, m, 4 * BLOCK):
                    i = mark[x : min(m, x + 4 * BLOCK)]
                    for y in range(m, z, BLOCK):
                        p = mark[y : min(z, y + BLOCK)]
                        r, c = np.nonzero(linked(p[:, None], i[None, :]))
                        out.append(_forest(p[r], i[c], len(p) + len(i)))
            ready = np.flatnonzero(~big & (pairs > 0))
            for part in np.split(ready, np.flatnonzero(np.diff(np.cumsum(pairs[ready]) // (BLOCK * BLOCK))) + 1):
                if len(part):
                    of_run, n = np.repeat(part, pairs[part]), pairs[part]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    width = (mid - start)[of_run]
                    p, i = mark[mid[of_run] + nth // width], mark[start[of_run] + nth % width]
                    ok = linked(p, i)
                    out.append(_forest(p[ok], i[ok], int((end - start)[part].sum())))
            if out:
                u, v = (np.concatenate(x) for x in zip(*out, strict=True))
                if len(u):
                    uv = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(uv[:, 0])), pa.array(np.ascontiguousarray(uv[:, 1]))], ["u", "v"])

    return of


def links(marks: DataFrame, max_bits: int = 3) -> DataFrame:
    """marks: distinct fingerprints. Links u, v with the same components as the relation "at most max_bits bits differ"."""
    if not 0 < max_bits <= 3:
        raise ValueError("the keys find links of one to three bits")
    schema = "key long, look boolean, fingerprint long"
    indexed = marks.mapInArrow(_emit_keys((True,)), schema)
    hot = stored(indexed.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.ceil(F.col("count") / HOT_KEY).cast("int").alias("parts")), "simhash-hot")
    rows = marks.mapInArrow(_emit_keys((True, False)), schema)
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= 10_000 else hot
        parts = F.coalesce("parts", F.lit(1))
        mine = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
        rows = rows.join(small, "key", "left").withColumn("part", F.explode(F.when(F.col("look"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(mine))))
        rows = rows.select((F.col("part").cast("long") * F.lit(1 << 38) + F.col("key")).alias("key"), "look", "fingerprint")
    dealt = rows.repartition("key").sortWithinPartitions("key", "look")
    return dealt.mapInArrow(_verify(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of the document's group) for every row of docs."""
    spark = docs.sparkSession
    marked = stored(fingerprints(docs, id_col, text_col, words), "simhash-fingerprints")
    nodes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    joined = components(links(nodes.select("fingerprint"), max_bits), "simhash-components")
    rooted = nodes.join(joined, F.col("fingerprint") == F.col("u"), "left").select("fingerprint", "first_id", F.coalesce("v", "fingerprint").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = stored(salted_join(rooted.where("root <> fingerprint"), low, "root", "fingerprint").select("fingerprint", "component_id").unionAll(low.select("root", "component_id")), "simhash-members")
    discard(spark, joined, nodes)
    return salted_join(marked, member, "fingerprint", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near-duplicates: the one with the smallest id. A row without an id takes a
    negative one from its text for this; of rows with one id, one stays for each group that the id is the smallest of."""
    key = unused(docs, "key")
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 62))))
    grouped = near_duplicates(rows, key, text_col, words, max_bits)
    stay = grouped.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
