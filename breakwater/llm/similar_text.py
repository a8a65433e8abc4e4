"""Near-duplicate texts: operator 10's fuzzy hash keys, widened to similarity 0.8; the texts' shingle sets verify every pair.

Two texts link if the Jaccard similarity of their sets of five-word shingles is at least 0.8. The groups are the components of these links.
No pair links unverified.

Candidates come from Golay-code keys in two ways. Operator 10's own keys give all fingerprints (64 bits, the majority of each bit over
distinct shingles) that differ in at most three bits. At similarity 0.8 about 15 % of the bits differ, too many for whole segments to
survive, so there are TABLES x 3 segments of 23 further bits, and each bit keeps how far its majority goes: a segment is decoded to the
codewords that its WEAK least certain bits can lead to, and a table's keys are the TRIES triples of codeword indices (36 bits) that contradict
the bits least. The errors of a pair fall on the tables unevenly, and it is met if they are few in the weak places of one table. Of pairs at
exactly 0.8 a simulation meets 98 % (cosine 0.889), of closer ones more.

A key's members are not all paired, or a large group of near copies would cost the square of its size. In each turn every member proposes
the nearest member of another group of that key, by SKETCH of the further bits, among those whose group is no smaller there and that can be
as similar: the sizes of two sets bound their similarity, and so do their counts by classes of hashes, both exactly. It also proposes the nearest hub, which is the member of a group with the most links so far. New proposals are verified, groups merge, and the turns
go on while any merges. A key in which neither a group nor a link has changed since the last turn would propose what it has proposed, and waits. So proposals are at most two a member and key; members
that the exact bounds part from all other groups of a key leave it after the turn. That finds the components that all pairs of a key would give, but
where in every key and turn the bits take a pair below 0.8 for nearer than one above it.
A key with over PART members is taken in parts, dealt anew in every turn; equal texts are one member throughout.

What these keys and turns miss, an exact search finds after them, so the groups are those of all pairs at the similarity. Put in one order for all texts, two
sets that similar share one of their first n - ceil(similarity n) + 1 shingles (prefix filter). Shingles known to be frequent from a sample of SAMPLE texts come last,
so few texts share a prefix; the sample sets the order alone, and any order is exact. Of prefix shingles whose texts still lie in several groups, all pairs of texts of
different groups are taken that sizes, counts by COUNTS classes of hashes and the places of the shingle in both sets let be as similar: before the first shingle that two sets
have in common there are at most as many as they may differ by. A pair is passed on where none of the EARLIER shingles before is common to both, so where it meets first, and seldom again.
Those that have as many prefix shingles in common as the similarity needs are verified. All bounds are exact, and no pair is left out. A shingle of over SHARE texts is dealt out in pairs of blocks; where many
texts differ but share most of their text in frequent passages, the pairs grow with their square.

Edge cases: null and empty texts and texts of white space only are equal to each other; texts of fewer words than a shingle are one
shingle; rows of one id with different texts are different texts; a null id is replaced by one from the text; all columns may have any
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, discard, key_runs, small_batches, stored, unused
from .components import components
from .golay import CHECK, LENGTH, codeword, codeword_index
from .simhash import links, shingle_hashes, simhash

TABLES, SEGMENTS, WEAK, NEAR, TRIES = 5, 3, 6, 12, 32
BITS = TABLES * SEGMENTS * LENGTH
SKETCH = 320  # a whole number of 64-bit words
SIMILARITY_BOUND = 0.8  # what the keys are made for
FARTHEST = 104  # of SKETCH bits; at similarity 0.8, 48.5 +- 6.4 differ, for the smallest sets 60 +- 7: one pair in 10^9 is beyond
COUNTS = 64  # classes of shingle hashes
PART = 2048
BLOCK = 1024
SAMPLE, FREQUENT, MOST_FREQUENT = 8192, 4, 1 << 17  # texts sampled for the order of shingles, how many of them have a frequent one, frequent ones held
SHARE = 4096
EARLIER = 4  # shingles of the prefix before this one that a text's row has with it
CELLS = 1 << 18  # pairs compared at once
FAR = 1 << 60
PROPOSED = ["u", "v", "key", "node", "again"]
LEFT, PARTED = 1, 2  # why a key is taken again though no group in it has changed: rows that left it have let others propose, it is dealt into other parts


def _more_bits(hashes: np.ndarray) -> np.ndarray:
    """BITS further bits of each 64-bit hash, by the splitmix64 finaliser of its successors, as 0/1."""
    step = np.arange(1, -(-BITS // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = hashes.astype(np.uint64)[:, None] + step
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8).reshape(len(hashes), -1), axis=1, count=BITS, bitorder="little")


def soft_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of BITS bits its majority's sign and, in 32nds of a standard deviation, how far it goes: int8."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += _more_bits(hashes[at : at + 4096]).sum(0, dtype=np.int32)
    return np.clip(np.rint((2 * ones - len(hashes)) * (32 / max(1.0, len(hashes) ** 0.5))), -127, 127).astype(np.int8)


def frequent_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that several of about SAMPLE different texts have, the rarer ones first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view("<i8"))], ["shingle"])

    some = rows.where(F.pmod("text_hash", F.lit(max(1, rows.count() // SAMPLE))) == 0).dropDuplicates(["text_hash"]).select("text")
    counts = some.mapInArrow(of, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).select("shingle").collect()
    return np.array([r.shingle for r in found], "<i8").view("<u8")[::-1]


def prefix(hashes: np.ndarray, similarity: float, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's hashes: a set of that similarity, ordered likewise, has one of them among its own first. known: frequent ones, ascending, which
    come last, by their rank."""
    if not len(hashes):
        return hashes
    size = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    order = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        order = np.where(known[at] == hashes, rank[at] + 1, 0)
    return hashes[np.lexsort((hashes, order))[:size]]


def sketches(rows: DataFrame, words: int, similarity: float = SIMILARITY_BOUND, frequent: np.ndarray | None = None) -> DataFrame:
    """Of rows (doc_id, text, text_hash): doc_id, text_hash, digest of the words (16 bytes), fingerprint (long), n (distinct shingles), counts
    (how many of them are in each class of hashes, clipped at 255), soft (BITS bytes; null for no words), prefix (hashes of 8 bytes)."""
    last = np.zeros(0, "<u8") if frequent is None else frequent
    rank = np.argsort(last)
    known = last[rank]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, mark, size, counts, soft, first = [], [], [], [], [], []
            for t in b.column(1):
                text = t.as_py()
                hashes = np.unique(shingle_hashes(text, words))
                digest.append(xxhash.xxh3_128_digest(b" ".join(ascii_words(text))))
                mark.append(simhash(hashes))
                size.append(len(hashes))
                counts.append(np.minimum(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes())
                soft.append(soft_bits(hashes).tobytes() if len(hashes) else None)
                first.append(prefix(hashes, similarity, known, rank).tobytes())
            made = [pa.array(digest, pa.binary()), pa.array(mark, pa.int64()), pa.array(size, pa.int64()), pa.array(counts, pa.binary()), pa.array(soft, pa.binary()), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], ["doc_id", "text_hash", "digest", "fingerprint", "n", "counts", "soft", "prefix"])

    return rows.mapInArrow(of, "doc_id long, text_hash long, digest binary, fingerprint long, n long, counts binary, soft binary, prefix binary")


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first SKETCH soft bits as bits."""
    for b in batches:
        soft = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(-1, BITS)
        bits = np.packbits(soft[:, :SKETCH] > 0, axis=1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in bits], pa.binary()), b.column(3)], ["node", "n", "sketch", "counts"])


def _decode(soft: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices [n, NEAR] of codewords near soft words [n, 23] and what they contradict; infinite where there are fewer."""
    sure = np.abs(soft).astype(np.float32)
    word = ((soft > 0).astype(np.int64) << np.arange(LENGTH)).sum(1)
    masks = np.zeros((len(soft), 1), np.int64)
    for bit in np.argsort(sure, axis=1, kind="stable")[:, :WEAK].T:
        masks = np.concatenate((masks, masks | (1 << bit)[:, None]), 1)
    code = np.sort(codeword_index(word[:, None] ^ masks), axis=1)
    differ = codeword(code) ^ word[:, None]
    cost = np.zeros(code.shape, np.float32)
    for b in range(LENGTH):
        cost += (differ >> b & 1) * sure[:, b, None]
    cost[:, 1:][code[:, 1:] == code[:, :-1]] = np.inf
    best = np.argsort(cost, axis=1, kind="stable")[:, :NEAR]
    return np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)


def soft_keys(soft: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of soft words [n, BITS], and the row of each."""
    keys, rows = [], []
    for t in range(TABLES):
        key, cost = np.full((len(soft), 1), t, np.int64), np.zeros((len(soft), 1), np.float32)
        for s in range(t * SEGMENTS, (t + 1) * SEGMENTS):
            code, more = _decode(soft[:, s * LENGTH : (s + 1) * LENGTH])
            key = (key[:, :, None] << (LENGTH - CHECK) | code[:, None, :]).reshape(len(soft), -1)
            cost = (cost[:, :, None] + more[:, None, :]).reshape(len(soft), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :TRIES]
            key, cost = np.take_along_axis(key, best, 1), np.take_along_axis(cost, best, 1)
        real = np.isfinite(cost)
        keys.append(key[real])
        rows.append(np.nonzero(real)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            soft = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int8).reshape(-1, BITS)
            keys, rows = soft_keys(soft)
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(pa.array(rows))], ["key", "node"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, n, place: every shingle of a prefix, and where it stands there."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            first = [np.frombuffer(x.as_py(), "<i8") for x in part.column(2)]
            of = pa.array(np.repeat(np.arange(len(first)), [len(x) for x in first]))
            place = pa.array(np.concatenate([np.arange(len(x), dtype=np.int32) for x in first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), part.column(0).take(of), part.column(1).take(of), place], ["key", "node", "n", "place"])


def _alike(similarity: float):
    """key, node, place of rows sorted by key and n whose key has another row of a size that allows the similarity: if any has, a neighbour has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.select(["key", "node", "place"]) for b in _shared(batches, similarity))

    return of


def _shared(batches: Iterator[pa.RecordBatch], similarity: float = 0) -> Iterator[pa.RecordBatch]:
    """Rows of key-sorted batches whose key has more than one, and, with a similarity, a neighbour by n of such a size. A row is held back until its successor is seen,
    so a key may have any number."""
    last, known = None, False  # the row held back, and whether it shares its key with the one before
    for b in batches:
        if not b.num_rows:
            continue
        now = b if last is None else pa.concat_batches([last, b])
        key = now["key"].to_numpy()
        same = key[1:] == key[:-1]
        if similarity:
            n = now["n"].to_numpy()
            same &= n[:-1] >= similarity * n[1:] - 1e-6
        before = np.concatenate(([known], same))
        yield now.slice(0, now.num_rows - 1).filter(pa.array(before[:-1] | same))
        last, known = now.slice(now.num_rows - 1), bool(before[-1])
    if last is not None and known:
        yield last


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column of `width` bytes a row, as 64-bit words."""
    flat = pa.concat_arrays(column.chunks).cast(pa.binary(width))
    return np.frombuffer(flat.buffers()[1], "<u8", len(flat) * width // 8, flat.offset * width).reshape(-1, width // 8)


def _crowds(run: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row, how many rows of its run have its label."""
    order = np.lexsort((label, run))
    r, x = run[order], label[order]
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
    out = np.empty(len(run), np.int64)
    out[order] = np.diff(np.append(np.flatnonzero(first), len(run)))[np.cumsum(first) - 1]
    return out


def _hubs(run: np.ndarray, label: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Whether a row has the most links, two at least, among those of its run with its label."""
    order = np.lexsort((-links, label, run))
    r, x = run[order], label[order]
    out = np.zeros(len(run), bool)
    out[order] = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
    return out & (links > 1)


def _changed(run: np.ndarray, label: np.ndarray, kept: np.ndarray, hubs: np.ndarray) -> np.ndarray:
    """Runs in which rows that leave change who proposes to whom: a hub is among them, or groups compare otherwise by their rows."""
    order = np.lexsort((label, run))
    r, x = run[order], label[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]))))
    before, after, of = np.diff(np.append(first, len(r))), np.add.reduceat(kept[order].astype(np.int64), first), r[first]
    before, after, of = (a[after > 0] for a in (before, after, of))
    by_size = np.lexsort((after, before, of))
    b, a, of = before[by_size], after[by_size], of[by_size]
    other = (of[1:] == of[:-1]) & (((b[1:] > b[:-1]) != (a[1:] > a[:-1])) | (a[1:] < a[:-1]))
    return np.unique(np.concatenate((of[1:][other], run[hubs & ~kept])))


def _search(t: pa.Table, start: np.ndarray, size: np.ndarray, crowd: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """For each row, the row of its run that is nearest by sketch among the allowed ones of another label; -1 if there is none. The other group may
    not have fewer rows here, and sizes and counts must allow the similarity."""
    label, n, sketch = t["label"].to_numpy(), t["n"].to_numpy(), _fixed(t["sketch"], SKETCH // 8)
    counts = _fixed(t["counts"], COUNTS).view(np.uint8)
    best = np.full(len(label), -1, np.int64)

    def value(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
        fits = np.minimum(n[i], n[j]) >= SIMILARITY_BOUND * np.maximum(n[i], n[j])
        fits &= allowed[j] & (label[i] != label[j]) & (crowd[j] >= crowd[i]) & (far <= FARTHEST)
        at = np.nonzero(fits)
        a, b = (np.broadcast_to(x, far.shape)[at] for x in (i, j))
        can = np.empty(len(a), bool)
        for x in range(0, len(a), BLOCK * 64):
            u, v = a[x : x + BLOCK * 64], b[x : x + BLOCK * 64]
            both = np.minimum(counts[u], counts[v])
            most = both.sum(1, dtype=np.int64)  # of common shingles, but where a count of both is clipped
            can[x : x + BLOCK * 64] = (most * (1 + SIMILARITY_BOUND) >= SIMILARITY_BOUND * (n[u] + n[v]) - 1e-6) | (both.max(1, initial=0) == 255)
        fits[at] = can
        return np.where(fits, far << 32 | j, FAR)

    small = np.flatnonzero((size > 1) & (size <= BLOCK // 2))
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(size[small] ** 2) // CELLS)) + 1):
        if not len(part):
            continue
        m = size[part]
        nth = np.arange((m**2).sum()) - np.repeat(np.cumsum(m**2) - m**2, m**2)
        base, width = np.repeat(start[part], m**2), np.repeat(m, m**2)
        i, j = base + nth // width, base + nth % width
        cells = value(i, j, np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64))
        first = np.cumsum(np.repeat(m, m)) - np.repeat(m, m)
        best[i[first]] = np.minimum.reduceat(cells, first)
    for k in np.flatnonzero(size > BLOCK // 2):
        j = np.arange(start[k], start[k] + size[k])
        for x in range(0, size[k], CELLS // PART):
            i = j[x : x + CELLS // PART]
            far = sum(np.bitwise_count(sketch[i, None, w] ^ sketch[None, j, w]).astype(np.int64) for w in range(sketch.shape[1]))
            best[i] = value(i[:, None], j[None, :], far).min(1)
    return np.where((best >= 0) & (best < FAR), best & 0xFFFFFFFF, -1)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member of a key, its nearest in another group of that key and its nearest hub there, as pairs u, v; and the rows (key, node) that can
    have a partner in another group of their key: as groups only merge, the others have none in any later turn. Keys with over PART members are
    taken in parts, and all their rows stay. again tells whether the key would propose otherwise in the next turn, its groups unchanged."""
    last = None
    for t in key_runs(batches, "key", 4 * PART):
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        rows = np.arange(len(key))
        change = np.concatenate(([True], key[1:] != key[:-1]))
        change |= (rows - rows[change][np.cumsum(change) - 1]) % PART == 0
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(key)))
        run, label = np.repeat(start, size), t["label"].to_numpy()
        crowd, hubs = _crowds(run, label), _hubs(run, label, t["links"].to_numpy())
        found = [_search(t, start, size, crowd, np.ones(len(key), bool))] + ([_search(t, start, size, crowd, hubs)] if hubs.any() else [])
        some, other = (np.concatenate(x) for x in zip(*((np.flatnonzero(f >= 0), f[f >= 0]) for f in found), strict=True))
        if len(some):
            a, b = node[some], node[other]
            uv = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0)
            none = pa.nulls(len(uv), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(uv[:, 0])), pa.array(np.ascontiguousarray(uv[:, 1])), none, none, pa.nulls(len(uv), pa.int32())], PROPOSED)
        partner = found[0] if (crowd == 1).all() else _search(t, start, size, np.zeros_like(crowd), np.ones(len(key), bool))
        named = np.isin(key, key[np.repeat(size >= PART, size)]) | (key == last)
        kept = (partner >= 0) | named
        again = np.where(named, PARTED, np.where(np.isin(run, _changed(run, label, kept, hubs)), LEFT, 0)).astype(np.int32)
        stay = np.flatnonzero(kept)
        last, none = key[-1] if named[-1] else None, pa.nulls(len(stay), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(key[stay]), pa.array(node[stay]), pa.array(again[stay])], PROPOSED)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node, shingles (their distinct hashes, ascending, as bytes) of texts (node, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(of, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose sets are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("of_u")), "u")
    return with_u.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("of_v")), "v").select("u", "v", "of_u", "of_v").mapInArrow(of, "u long, v long")


def _texts_of(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """_sets() of nodes (node, doc_id, text_hash), from rows (doc_id, text, text_hash)."""
    named = rows.join(nodes.select("doc_id", "text_hash", "node"), ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text"))
    return _sets(named.select("node", "text"), words)


def _cells(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within runs, some at a time."""
    small = np.flatnonzero((size > 1) & (size <= BLOCK // 2))
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(size[small] ** 2) // CELLS)) + 1):
        m = size[part]
        nth = np.arange((m**2).sum()) - np.repeat(np.cumsum(m**2) - m**2, m**2)
        base, width = np.repeat(start[part], m**2), np.repeat(m, m**2)
        yield base + nth // width, base + nth % width
    for k in np.flatnonzero(size > BLOCK // 2):
        j = np.arange(start[k], start[k] + size[k])
        step = max(1, CELLS // int(size[k]))
        for x in range(0, size[k], step):
            i = j[x : x + step]
            yield np.repeat(i, len(j)), np.tile(j, len(i))


def _candidates(similarity: float):
    """Of unit-sorted rows (unit, node, label, n, place, earlier, counts): u, v, need: the pairs of a unit's nodes with different labels whose sizes, places and counts allow the
    similarity and that have met at none of both their earlier keys, and how many prefix shingles they share at least: of the set whose prefix ends first, only the rest can be shared
    besides."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "unit"):
            unit, node, label, n, place = (t[c].to_numpy() for c in ("unit", "node", "label", "n", "place"))
            counts, earlier = _fixed(t["counts"], COUNTS).view(np.uint8), [t[f"earlier{k}"].to_numpy() for k in range(EARLIER)]
            start = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            for i, j in _cells(start, np.diff(np.append(start, len(unit)))):
                fits = (node[i] > node[j]) & (label[i] != label[j])
                i, j = i[fits], j[fits]
                common = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6).astype(np.int64)  # shingles of a pair as similar, at least
                fits = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6) & (place[i] <= n[i] - common) & (place[j] <= n[j] - common)
                i, j, common = i[fits], j[fits], common[fits]
                fits = np.ones(len(i), bool)
                for x in earlier:
                    for y in earlier:
                        fits &= (x[i] != y[j]) | (x[i] == 0)  # 0: there is none
                i, j, common = i[fits], j[fits], common[fits]
                for x in range(0, len(i), BLOCK * 64):
                    a, b, least = i[x : x + BLOCK * 64], j[x : x + BLOCK * 64], common[x : x + BLOCK * 64]
                    both = np.minimum(counts[a], counts[b])
                    can = (both.sum(1, dtype=np.int64) * (1 + similarity) >= similarity * (n[a] + n[b]) - 1e-6) | (both.max(1, initial=0) == 255)
                    a, b, least = a[can], b[can], least[can]
                    if len(a):
                        need = least - np.ceil(similarity * np.maximum(n[a], n[b]) - 1e-9).astype(np.int64) + 1
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[a], node[b], need)], ["u", "v", "need"])

    return of


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, place, size: the texts of every key with several groups, and how many the key has. shared: key, node, place."""
    named = shared.join(labels.select(F.col("u").alias("node"), "v"), "node", "left").select("key", "node", F.coalesce("v", "node").alias("label"), "place")
    sizes = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
    return named.join(sizes.select("key", "size"), "key")


def _units(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """unit, node, label, n, place, the node's EARLIER keys before this one, counts; two texts of a key meet in one unit at least."""
    along = Window.partitionBy("node").orderBy("place")  # at most a prefix
    before = [F.coalesce(F.lag("key", k + 1).over(along), F.lit(0).cast("bigint")).alias(f"earlier{k}") for k in range(EARLIER)]
    known = mixed.select("*", *before).join(texts.select("node", "n", "counts"), "node")
    met = known.withColumn("blocks", F.ceil(F.col("size") / SHARE)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    dealt = met.withColumn("other", F.explode(others))
    return dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "node", "label", "n", "place", *(f"earlier{k}" for k in range(EARLIER)), "counts")


def _missed(shared: DataFrame, labels: DataFrame, texts: DataFrame, rows: DataFrame, tried: DataFrame, words: int, similarity: float, spent: list[DataFrame]) -> DataFrame:
    """u, v: all links between different groups. shared: key, node, place, the prefix shingles that several texts have."""
    mixed = stored(_mixed(shared, labels), "similar-mixed")
    dealt = _units(mixed, texts).repartition("unit").sortWithinPartitions("unit")
    found = dealt.mapInArrow(_candidates(similarity), "u long, v long, need long").distinct().join(tried, ["u", "v"], "left_anti")
    met = beside = stored(found, "similar-met")
    ends = met.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    keys = stored(mixed.join(ends, "node", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys")), "similar-met-keys")
    for side in ("u", "v"):
        beside = beside.join(keys.select(F.col("node").alias(side), F.col("keys").alias("of_" + side)), side)
    pairs = stored(beside.where(F.size(F.array_intersect("of_u", "of_v")) >= F.col("need")).select("u", "v"), "similar-candidates")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stored(_texts_of(rows, texts.join(ends, "node"), words), "similar-candidate-sets")
    spent += [mixed, met, keys, pairs, sets]
    return stored(_verified(pairs, sets, similarity), "similar-missed")


def _close(texts: DataFrame, max_bits: int) -> DataFrame:
    """u, v: operator 10's links of texts (node, fingerprint), equal fingerprints among them."""
    marks = stored(texts.groupBy("fingerprint").agg(F.min("node").alias("first")), "similar-marks")
    equal = texts.join(marks, "fingerprint").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    named = links(marks.select("fingerprint"), max_bits)
    for side in ("u", "v"):
        named = named.join(marks.select(F.col("fingerprint").alias(side), F.col("first").alias("node_" + side)), side)
    return equal.unionAll(named.select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v")))


def _states(labels: DataFrame, earlier: DataFrame | None, more: DataFrame) -> DataFrame:
    """node, v (its group's smallest node, or null if it is that), touched: whether its group's name or its links are new since the turn before."""
    now = labels.select("u", "v", F.lit(1).alias("new"))
    both = now if earlier is None else now.unionAll(earlier.select("u", "v", F.lit(0).alias("new")))
    named = both.groupBy("u", "v").agg(F.min("new").alias("new"), F.max("new").alias("holds")).where("holds = 1")
    linked = more.select(F.explode(F.array("u", "v")).alias("node"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("touched"))
    every = named.select(F.col("u").alias("node"), "v", (F.col("new") == 1).alias("touched")).unionAll(linked)
    return every.groupBy("node").agg(F.max("v").alias("v"), F.bool_or("touched").alias("touched"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two tables: node, doc_id, text_hash (a row of each text), and u, v (nodes that aren't the smallest of their group, with the smallest)."""
    if similarity < SIMILARITY_BOUND:
        raise ValueError(f"the keys find pairs of similarity {SIMILARITY_BOUND} or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    by_text = sketches(rows, words, similarity, frequent_shingles(rows, words)).groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), *(F.first(c).alias(c) for c in ("fingerprint", "n", "counts", "soft", "prefix")))
    nth = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("digest"))  # texts of one id are nodes of their own
    node = F.when(nth == 1, F.col("row.doc_id")).otherwise(-1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 62)))
    texts = stored(by_text.select(node.alias("node"), "row.doc_id", "row.text_hash", "fingerprint", "n", "counts", "soft", "prefix"), "similar-texts")
    firsts = texts.where("n > 0").select("node", "n", "prefix").mapInArrow(_spread, "key long, node long, n long, place int")
    shared = stored(firsts.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_alike(similarity), "key long, node long, place int"), "similar-prefixes")

    keyed = texts.where("soft is not null").select("node", "soft").mapInArrow(_emit, "key long, node long")
    runs = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long"), "similar-runs")
    close = stored(_close(texts, max_bits), "similar-close")
    ids = runs.select("node").unionAll(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    held = stored(texts.join(ids, "node").select("node", "doc_id", "text_hash", "n", "counts", "soft"), "similar-held")
    sets = stored(_texts_of(rows, held, words), "similar-sets")
    drawn = stored(held.where("soft is not null").select("node", "n", "soft", "counts").mapInArrow(_signs, "node long, n long, sketch binary, counts binary"), "similar-drawn")

    tried = good = labels = earlier = more = None
    spent = [shared, runs, close, held, sets, drawn]
    for turn in count():
        if labels is None:
            here = runs.withColumn("label", F.col("node")).join(drawn.withColumn("links", F.lit(0)), "node")
        else:  # only keys that still hold several groups, and would propose otherwise than in the turn before
            states = labels.select(F.col("u").alias("node"), "v", F.lit(True).alias("touched")) if turn == 1 else _states(labels, earlier, more)  # after the first turn all is new
            named = runs.join(states, "node", "left").select("key", "node", F.coalesce("v", "node").alias("label"), (F.coalesce("touched", F.lit(False)) | (F.col("again") >= (LEFT if turn == 2 else PARTED))).alias("go"))
            mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("go").alias("go")).where("low < high" + (" AND go" if turn > 1 else "")).select("key")
            named = named.drop("go")
            ends = good.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("links"))
            here = named.join(mixed, "key", "left_semi").join(drawn.join(ends, "node", "left").fillna(0, ["links"]), "node")
        dealt = here.repartition("key").sortWithinPartitions("key", F.xxhash64("node", F.lit(turn)))
        made = stored(dealt.mapInArrow(_nearest, "u long, v long, key long, node long, again int"), "similar-turn")
        spent.append(made)
        if turn < 2:  # later turns take only some keys, and the others may be taken again
            runs = made.where("node IS NOT NULL").select("key", "node", "again")
        proposed = made.where("u IS NOT NULL").select("u", "v")
        fresh = (proposed.unionAll(close) if labels is None else proposed).distinct()
        fresh = stored(fresh if tried is None else fresh.join(tried, ["u", "v"], "left_anti"), "similar-proposed")
        more = stored(_verified(fresh, sets, similarity), "similar-good")
        spent += [fresh, more]
        if labels is not None and more.isEmpty():
            break
        labels, earlier = components(more if labels is None else labels.unionAll(more), "similar-groups"), labels
        if earlier is not None:
            spent.append(earlier)
        tried, good = (fresh, more) if tried is None else (tried.unionAll(fresh), good.unionAll(more))
    more = _missed(shared, labels, texts, rows, tried, words, similarity, spent)
    spent.append(more)
    if not more.isEmpty():
        spent.append(labels)
        labels = components(labels.unionAll(more), "similar-groups")
    discard(docs.sparkSession, *spent)
    return texts.select("node", "doc_id", "text_hash"), labels


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near-duplicate texts: the one with the smallest id. A row without an id takes a
    negative one from its text for this."""
    key, mark = unused(docs, "key"), unused(docs, "mark")
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 62)))).withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    with small_batches(docs.sparkSession):
        texts, grouped = groups(rows, key, text_col, words, similarity)
    stay = texts.join(grouped.select(F.col("u").alias("node")), "node", "left_anti").select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark))
    return rows.join(stay, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*docs.columns)
