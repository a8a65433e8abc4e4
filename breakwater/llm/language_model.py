"""Operator 3: scores of texts under a hierarchical Pitman-Yor language model.

The restaurant of a context has the words that follow it as dishes; its tables are customers of the root restaurant, which all contexts
share as parent, and whose own base is uniform over the known words and one unknown. A context is the preceding word, addressed by a
hash whose range grows as vocabularies do, with the square root of the text (65,536 at least); words that meet there share a restaurant.
Seats are sampled by Gibbs: in every sweep all customers of a dish leave and sit down anew, at tables in proportion to their size less the
discount or at new ones in proportion to the parent's probability, in one draw however many they are (exact up to 1024 customers of a
dish, from the scaling limit beyond). Scores use the predictive probabilities averaged over the samples, each with its own totals, so that each
sample's distribution sums to one.

How it runs. Tasks cut their documents into blocks and count (word, context, document) in each; the counts go to buckets by the word's hash,
as packed arrays: that is the one shuffle of the corpus. A bucket has all customers of its words in every context, and the root's tables
for them, so bucket work is local but for the restaurants' totals, one number a context and sample. There are as many buckets as the text
fills at BUCKET_BYTES each, so a bucket has some million tokens at every size. A word with more than half a bucket's tokens is hot: there
are at most 2 x buckets of them. Its contexts are dealt over several buckets, and its place in the root becomes one of the totals. Draws are
seeded by word and context: scores depend neither on partitions nor on settings, the scoring pass replays the chain whose totals the pass
before has summed, and a lost executor's buckets come out as they were. Sums go back to each block's documents.

Only words of the training documents are customers. Hashes of words have 64 bits.

Edge cases: null and empty texts have the end token alone; repeated rows are scored (and learnt from) each; a null id counts as the
empty text in the split; without training documents every probability is 1 / (V + 1) = 1; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, checksum_class, discard, small_batches, stored

BUCKET_BYTES = 6_000_000  # text in a bucket, some million tokens
BLOCK_TOKENS, BLOCK_DOCS = 500_000, 30_000
EXACT = 1024  # customers of a dish up to which its seatings are counted exactly
CELLS = 500_000
START, END = b"\n", b" "  # no words
NAMES = ["bucket", "block", "words", "pairs", "contexts", "entries", "docs", "counts", "ids", "held", "tokens"]
BLOCK = "bucket int, block string, " + ", ".join(f"{n} binary" for n in NAMES[2:])
STATE = "bucket int, block array<string>, " + ", ".join(f"{n} array<binary>" for n in NAMES[2:])


@dataclass(frozen=True)
class Totals:
    """What all buckets share. By context: customers; by sample and context: tables; by sample: the root's customers and tables."""

    contexts: int
    words: int  # tokens of the training documents
    types: int  # distinct words of them
    discounts: tuple[float, float]  # of contexts, of the root
    customers: np.ndarray
    tables: np.ndarray
    root_customers: np.ndarray
    root_tables: np.ndarray
    hot: np.ndarray  # hashes of hot words, ascending; their training tokens; by sample: their customers and tables in the root
    hot_words: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray


STRENGTHS = (1.0, 1.0)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array and how often each occurs."""
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[starts], np.diff(np.append(starts, len(x)))


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit key and turn (splitmix64): draws depend on words alone, not on where or with what they run."""
    x = keys.astype("<u8") + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the task's words and their counts, passed on whenever they have become many."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        hashes = np.fromiter(map(_word_hash, counts), "<u8", len(counts)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["word", "n"])

    for b in batches:
        for t in b.column(0):
            counts.update(ascii_words(t.as_py()))
            counts[END] += 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
    yield out()


def _hot_words(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with half a bucket's share of the tokens or more, ascending, and over how many parts of their contexts each is dealt:
    at most 2 x buckets of them come to the driver."""
    if buckets == 1:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    counts = texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-model-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * (2 * buckets) >= total).toPandas()
    discard(texts.sparkSession, counts)
    hashes = rows["word"].to_numpy(np.int64).view("<u8")
    order = np.argsort(hashes)
    return hashes[order], np.ceil(rows["n"].to_numpy()[order] * 2 * buckets / max(1, total)).astype(np.int64)


def _blocks(buckets: int, contexts: int, hot: np.ndarray, parts: np.ndarray):
    bits = contexts.bit_length() - 1

    def made(name: str, docs: list[tuple], spans: list[np.ndarray], vocab: dict[bytes, int]) -> pa.RecordBatch:
        hashes = np.fromiter(map(_word_hash, vocab), "<u8", len(vocab))
        order = np.argsort(hashes)
        rank = np.empty(len(vocab), np.int64)
        rank[order] = np.arange(len(vocab))
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        token = np.concatenate(spans)
        before = np.concatenate(([0], token[:-1]))
        before[np.cumsum(sizes) - sizes] = vocab[START]
        key = (rank[token] << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64)[before]) << 15 | np.repeat(np.arange(len(docs)), sizes)
        del token, before
        key, count = np.unique(key, return_counts=True)
        hashes = hashes[order]
        split = np.ones(len(hashes), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
            split = np.where(hot[at] == hashes, parts[at], 1)
        word, context = key >> 15 + bits, key >> 15 & (contexts - 1)
        home = ((hashes % np.uint64(buckets)).astype(np.int64)[word] + context % split[word]) % buckets
        by_home = np.argsort(home, kind="stable")
        key, count, ends = key[by_home], count[by_home].astype("<u4"), np.cumsum(np.bincount(home, minlength=buckets))
        held = np.fromiter((d[1] for d in docs), bool, len(docs))
        rows: list[tuple] = []
        for b, (a, z) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
            if a == z:
                continue
            pair, doc = key[a:z] >> 15, key[a:z] & ((1 << 15) - 1)
            pair, entries = _runs(pair)
            word, pairs = _runs(pair >> bits)
            packed = (hashes[word], pairs.astype("<u4"), (pair & (contexts - 1)).astype("<u4"), entries.astype("<u4"), (doc << 1 | held[doc]).astype("<u2"), count[a:z])
            rows.append((b, name, *map(_pack, packed), None, None, None))
        ids = pa.array([d[0] for d in docs], pa.int64())
        listed = pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("id", pa.int64())]))
        listed.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
        listed.close()
        rows.append((xxhash.xxh32_intdigest(name) % buckets, name, *[None] * 6, sink.getvalue().to_pybytes(), _pack(held), _pack(sizes)))
        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 9]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0

        def fresh() -> tuple[list, list, dict]:
            vocab: dict[bytes, int] = defaultdict()
            vocab.default_factory = vocab.__len__
            vocab[START], vocab[END]  # noqa: B018  they take the first places
            return [], [], vocab

        docs, spans, vocab = fresh()
        tokens = 0
        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = ascii_words(t.as_py())
                words.append(END)
                spans.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                docs.append((i, h))
                tokens += len(words)
                if tokens >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    yield made(f"{part}-{nth}", docs, spans, vocab)
                    vocab.default_factory = None  # it refers to vocab, which would stay until the collector finds the circle
                    (docs, spans, vocab), tokens, nth = fresh(), 0, nth + 1
        if docs:
            yield made(f"{part}-{nth}", docs, spans, vocab)

    return of


def _gathered(key: tuple, rows: pa.Table) -> pa.Table:
    lists = [pa.array([rows[n].to_pylist()], pa.list_(pa.string() if n == "block" else pa.binary())) for n in NAMES[1:]]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *lists], NAMES)


class _Bucket:
    """A bucket's words and (word, context) pairs with their training counts. Documents stay packed, by block."""

    def __init__(self, row: dict, contexts: int, hot: np.ndarray) -> None:
        self.row = row
        bits = contexts.bit_length() - 1
        self.number = row["bucket"]
        self.kept = [k for k, w in enumerate(row["words"]) if w is not None]
        words, keys = [np.zeros(0, "<u8")], [np.zeros(0, np.int64)]
        for k in self.kept:
            words.append(_unpack(row["words"][k], "<u8"))
        self.types = np.unique(np.concatenate(words))
        for k, w in zip(self.kept, words[1:], strict=True):
            keys.append(np.repeat(np.searchsorted(self.types, w) << bits, _unpack(row["pairs"][k], "<u4")) | _unpack(row["contexts"][k], "<u4"))
        key = np.concatenate(keys)
        key.sort()  # in place; each block then finds its pairs, so that no copy of all blocks' pairs has to be held with its places
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        self.pairs_of, self.count = [], np.zeros(len(key), np.int64)
        for nth, k in enumerate(self.kept, 1):
            self.pairs_of.append(np.searchsorted(key, keys[nth]).astype(np.int32))
            keys[nth] = None
            entries, doc, count = self.entries(k)
            np.add.at(self.count, self.pairs_of[-1], np.add.reduceat(np.where(doc & 1, 0, count), np.cumsum(entries) - entries))
        self.word, self.context = key >> bits, key & (contexts - 1)
        del key
        self.many = np.flatnonzero(self.count > 1)  # pairs with more than one seating
        self.names = self.types[self.word[self.many]] ^ (self.context[self.many] + 1).astype("<u8") * np.uint64(0xD6E8FEB86659FD93)  # of those
        at = np.searchsorted(hot, self.types)
        is_hot = np.isin(self.types, hot)
        self.hot = np.where(is_hot, at, -1)
        self.word_count = np.where(is_hot, 0, np.bincount(self.word, self.count, minlength=len(self.types))).astype(np.int64)

    def entries(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one block: entries of each pair; document (with the held-out bit) and count of each entry."""
        return _unpack(self.row["entries"][k], "<u4").astype(np.int64), _unpack(self.row["docs"][k], "<u2").astype(np.int64), _unpack(self.row["counts"][k], "<u4").astype(np.int64)

    def own(self, x: np.ndarray) -> np.ndarray:
        """Per word, with nothing for hot ones."""
        return np.where(self.hot < 0, x, 0)

    def at_hot(self, x: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Per word, with the totals of hot ones."""
        return np.where(self.hot < 0, x, hot[self.hot] if len(hot) else 0)


@lru_cache(maxsize=4)
def _seatings(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log S(c, t) - log S(c, 1) for c and t up to EXACT (minus infinity for t > c), and what scales to more customers. S are the generalised
    Stirling numbers, sums over all seatings of c customers at t tables of the tables' rising factorials, by their recurrence.

    S(c, t) d^t t! is, but for a factor of c, the probability that t draws from Sibuya's distribution sum to c, and that comes to depend
    on t / c^d alone. The second result is the log of it, less log t, for c = EXACT."""
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT):
            logs[c + 1, 1:] = np.logaddexp(logs[c, :-1], logs[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
    logs[1:] -= logs[1:, 1:2]
    scaled = logs[EXACT].copy()
    scaled[1:] += (t - 1) * np.log(discount) + _log_factorials(EXACT)[:-1]
    scaled[0] = 0
    return logs, scaled


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def _reseat(count: np.ndarray, mass: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """All customers of every dish leave and sit down anew: the dish's tables t are drawn from their distribution given the rest, which is as
    mass^t S(count, t), by inversion at u. count: 2 or more. Without the count t - 1 would be Poisson with mean mass / discount, and the count only
    takes from the upper end; so what is beyond the widths has no weight."""
    logs, scaled = _seatings(discount)
    out = np.where(u < 1 / (1 + mass / (1 - discount)), 1, 2)  # two customers
    spread = mass / discount
    widths = np.minimum(count, np.ceil(40 + spread + 10 * np.sqrt(spread))).astype(np.int64)
    todo = np.flatnonzero(count > 2)
    todo = todo[np.argsort(widths[todo], kind="stable")[::-1]]
    at = 0
    while at < len(todo):
        width = int(widths[todo[at]])
        some = todo[at : at + max(1, CELLS // width)]
        at += len(some)
        t, c = np.arange(1, width + 1), count[some]
        row = np.empty((len(some), width))
        few = c <= EXACT
        row[few] = logs[np.minimum(c[few], EXACT)[:, None], np.minimum(t, EXACT)]
        row[few] = np.where(t <= c[few, None], row[few], -np.inf)
        if not few.all():
            shrunk = t * (EXACT / c[~few, None]) ** discount
            row[~few] = np.interp(shrunk, np.arange(EXACT + 1), scaled, right=-np.inf) - (t - 1) * np.log(discount) - _log_factorials(width - 1)[:width]
        row += np.log(mass[some])[:, None] * (t - 1)
        filled = np.cumsum(np.exp(row - row.max(1, keepdims=True)), 1)
        out[some] = 1 + (filled < u[some, None] * filled[:, -1:]).sum(1)
    return out


def _seat(count: np.ndarray, mass: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with any number of customers: none has none, one has one."""
    out = np.minimum(count, 1)
    many = np.flatnonzero(count > 1)
    if len(many):
        out[many] = _reseat(count[many], np.maximum(mass[many], 1e-12), discount, u[many])
    return out


def _chain(b: _Bucket, totals: Totals, burn_in: int, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Samples of the bucket's seats: tables of the pairs, customers and tables of the root's dishes. The totals of the round before
    (their mean over its samples) stand for those of other buckets."""
    d, d0 = totals.discounts
    tables, root_n, root_t = totals.tables.mean(0), totals.root_customers.mean(), totals.root_tables.mean()
    base = (STRENGTHS[1] + d0 * root_t) / (totals.types + 1)
    count, word = b.count[b.many], b.word[b.many]
    strength = (STRENGTHS[0] + d * tables)[b.context[b.many]]
    hot_parent = (totals.hot_customers.mean(0) - d0 * totals.hot_tables.mean(0) + base) / (STRENGTHS[1] + root_n)
    t = np.minimum(b.count, 1)
    for s in range(burn_in + samples + 1):
        customers = np.bincount(b.word, t, minlength=len(b.types)).astype(np.int64)
        own = b.own(customers)
        root = _seat(own, np.full(len(own), base), d0, _uniform(b.types, s))
        if s > burn_in:  # the seats after burn_in + 1 sweeps are the first sample
            yield t, customers, root
        if s < burn_in + samples:
            parent = b.at_hot((own - d0 * root + base) / (STRENGTHS[1] + root_n), hot_parent)
            t = np.minimum(b.count, 1)  # a new array: the one before may have been passed on
            t[b.many] = _seat(count, strength * parent[word], d, _uniform(b.names, s))


SUMS = "sample int, range int, packed binary"
RANGE = 1 << 14


class _Sums:
    """Sums of a task's buckets, by sample: of contexts, of named places below zero, of hot words (-10, -11, ...)."""

    def __init__(self, contexts: int, hot: np.ndarray) -> None:
        self.contexts, self.hot, self.of = contexts, hot, {}

    def add(self, sample: int, places: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> None:
        size = self.contexts + 10 + len(self.hot)
        held = self.of.setdefault(sample, np.zeros((2, size), np.int64))
        at = np.where(places < 0, self.contexts - 1 - places, places)
        held[0] += np.bincount(at, customers, minlength=size).astype(np.int64)
        held[1] += np.bincount(at, tables, minlength=size).astype(np.int64)

    def add_hot(self, sample: int, b: _Bucket, customers: np.ndarray, tables: np.ndarray) -> None:
        at = np.flatnonzero(b.hot >= 0)
        self.add(sample, -10 - b.hot[at], customers[at], tables[at])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for sample, held in self.of.items():
            for k, at in enumerate(range(0, held.shape[1], RANGE)):
                row = [[sample], [k], [_pack(held[:, at : at + RANGE])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["sample", "range", "packed"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One bucket at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _first_round(contexts: int, hot: np.ndarray):
    """Totals with one table a pair. Context -1: training tokens, types; -2: pairs seen once, twice; -3: root's dishes with one, two; of hot
    words: training tokens, customers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(contexts, hot)
        for row in _rows(batches):
            b = _Bucket(row, contexts, hot)
            sums.add(0, b.context, b.count, b.count > 0)
            ones = np.bincount(b.word[b.count > 0], minlength=len(b.types))
            own = b.own(ones)
            pairs = [(b.word_count.sum(), (b.word_count > 0).sum()), ((b.count == 1).sum(), (b.count == 2).sum()), ((own == 1).sum(), (own == 2).sum())]
            sums.add(0, np.array([-1, -2, -3]), *map(np.array, zip(*pairs, strict=True)))
            sums.add_hot(0, b, np.bincount(b.word, b.count, minlength=len(b.types)), ones)
        yield from sums.batches()

    return of


def _next_round(totals: Totals, chain: tuple[int, int]):
    """Totals of each sample. Context -1: the root's customers and tables, hot words left out; of hot words: customers, 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(totals.contexts, totals.hot)
        for row in _rows(batches):
            b = _Bucket(row, totals.contexts, totals.hot)
            for s, (t, customers, root) in enumerate(_chain(b, totals, *chain)):
                sums.add(s, b.context, np.zeros(len(t)), t)
                sums.add(s, np.array([-1]), b.own(customers).sum()[None], root.sum()[None])
                sums.add_hot(s, b, customers, np.zeros(len(b.types)))
        yield from sums.batches()

    return of


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    whole = sum(_unpack(x.as_py(), "<i8") for x in rows["packed"])
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([_pack(whole)], pa.binary())], ["sample", "range", "packed"])


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """By sample: customers and tables of the contexts, then of places -1, -2, ... (from -10 on those of hot words)."""
    found = sorted(rows.groupBy("sample", "range").applyInArrow(_added, SUMS).collect())
    return {s: np.concatenate([_unpack(r["packed"], "<i8").reshape(2, -1) for r in found if r["sample"] == s], 1) for s in {r["sample"] for r in found}}


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _learn(state: DataFrame, contexts: int, hot: np.ndarray, rounds: int, chain: tuple[int, int]) -> tuple[Totals, Totals]:
    """Totals that the last chain runs on, and those of its own samples."""
    size = contexts + 9 + len(hot)
    got = _summed(state.mapInArrow(_first_round(contexts, hot), SUMS)).get(0, np.zeros((2, size + 1), np.int64))
    (words, types), pairs, root = (tuple(map(int, got[:, contexts + k])) for k in range(3))
    hot_words, hot_customers = got[:, contexts + 9 : size]
    words, types = words + int(hot_words.sum()), types + int((hot_words > 0).sum())
    discounts = (_discount(*pairs), _discount(*root))
    customers, tables = got[:, :contexts]
    last = Totals(contexts, words, types, discounts, customers, tables[None], np.array([tables.sum()]), np.array([types]), hot, hot_words, hot_customers[None], np.minimum(hot_customers, 1)[None])
    before = last
    for _ in range(rounds):
        before = last
        base = (STRENGTHS[1] + discounts[1] * before.root_tables.mean()) / (types + 1)
        by_sample: list[tuple] = []
        for turn, g in sorted(_summed(state.mapInArrow(_next_round(before, chain), SUMS)).items()):
            n = g[0, contexts + 9 : size]
            t = _seat(n, np.full(len(n), base), discounts[1], _uniform(hot, turn))
            by_sample.append((g[1, :contexts], g[0, contexts] + n.sum(), g[1, contexts] + t.sum(), n, t))
        if by_sample:
            tables, root_n, root_t, n, t = map(np.array, zip(*by_sample, strict=True))
            last = Totals(contexts, words, types, discounts, customers, tables, root_n, root_t, hot, hot_words, n, t)
    return before, last


PART = "block string, doc binary, known binary, base binary, score binary, ids binary, held binary, tokens binary"
PART_NAMES = [x.split()[0] for x in PART.split(", ")]


def _score(before: Totals, last: Totals, chain: tuple[int, int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, d0 = last.discounts
        for row in _rows(batches):
            b = _Bucket(row, last.contexts, last.hot)
            mean = np.zeros(len(b.count))
            for s, (t, customers, root) in enumerate(_chain(b, before, *chain)):
                base = (STRENGTHS[1] + d0 * last.root_tables[s]) / (last.types + 1)
                parent = b.at_hot(customers - d0 * root, last.hot_customers[s] - d0 * last.hot_tables[s]) + base
                parent = parent / (STRENGTHS[1] + last.root_customers[s])
                share = (STRENGTHS[0] + d * last.tables[s])[b.context]
                mean += (b.count - d * t + share * parent[b.word]) / (STRENGTHS[0] + last.customers[b.context])
            logs = np.log10(mean / chain[1])
            seen = b.at_hot(b.word_count, last.hot_words)
            unigram = np.log10((seen + 1) / (last.words + last.types + 1))
            rows = []
            for k, pairs in zip(b.kept, b.pairs_of, strict=True):
                entries, doc, count = b.entries(k)
                pair = np.repeat(pairs, entries)
                word = b.word[pair]
                doc, of_doc = np.unique(doc >> 1, return_inverse=True)
                sums = [np.bincount(of_doc, count * x) for x in (seen[word] > 0, unigram[word], logs[pair])]
                packed = (_pack(np.diff(doc, prepend=0).astype("<u2")), _pack(sums[0].astype("<u4")), sums[1].astype("<f8").tobytes(), sums[2].astype("<f4").tobytes())
                rows.append((row["block"][k], *packed, None, None, None))
            rows += [(row["block"][k], None, None, None, None, i, row["held"][k], row["tokens"][k]) for k, i in enumerate(row["ids"]) if i is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "block" else pa.binary()) for n, c in zip(PART_NAMES, zip(*rows, strict=True), strict=True)], PART_NAMES)

    return of


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _by_document(train_tokens: int):
    def of(key: tuple, rows: pa.Table) -> pa.Table:
        parts = rows.to_pylist()
        about = next(p for p in parts if p["ids"] is not None)
        sizes = _unpack(about["tokens"], "<i8")
        known, base, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
        for p in sorted((p for p in parts if p["doc"] is not None), key=lambda p: (p["doc"], p["base"])):
            doc = np.cumsum(_unpack(p["doc"], "<u2"), dtype=np.int64)
            known[doc] += _unpack(p["known"], "<u4")
            base[doc] += np.frombuffer(p["base"], "<f8")
            score[doc] += np.frombuffer(p["score"], "<f4")
        ids = pa.ipc.open_stream(about["ids"]).read_all()["id"].combine_chunks()
        cols = [ids, pa.array(_unpack(about["held"], "?")), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), train_tokens)), pa.array(base), pa.array(score)]
        return pa.table(cols, [x.split()[0] for x in SCORES.split(", ")])

    return of


def score(docs: DataFrame, modulus: int = 7, held_class: int = 2, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, burn_in: int = 2, samples: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; documents of the held class teach nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (checksum_class(id_col, modulus) == held_class).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BUCKET_BYTES + 1
    contexts = 1 << max(16, int(np.ceil(np.log2(4 * (size + 1) ** 0.5))))
    with small_batches(docs.sparkSession):
        hot, parts = _hot_words(rows.select("text"), buckets)
        state = stored(rows.mapInArrow(_blocks(buckets, contexts, hot, parts), BLOCK).groupBy("bucket").applyInArrow(_gathered, STATE), "language-model")
        chain = (burn_in, samples)
        before, last = _learn(state, contexts, hot, rounds, chain)
        scores = stored(state.mapInArrow(_score(before, last, chain), PART).groupBy("block").applyInArrow(_by_document(last.words), SCORES), "language-model-scores")
    discard(docs.sparkSession, state)
    return scores
