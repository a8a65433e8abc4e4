"""A bucket of the language model: what it holds at once, and its seats against those drawn for all pairs."""

import tracemalloc

import numpy as np

from breakwater.llm import language_model as lm

CONTEXTS = 1 << 16


def bucket(blocks, words, seed=5):
    rng = np.random.default_rng(seed)
    vocab = np.sort(rng.integers(1, 1 << 63, words * 2).astype("<u8"))
    row = {"bucket": 0, **{n: [] for n in ("words", "pairs", "contexts", "entries", "docs", "counts")}}
    for _ in range(blocks):
        own = np.sort(rng.choice(vocab, words, replace=False))
        pairs = rng.integers(1, 6, words)
        contexts = np.concatenate([np.sort(rng.choice(CONTEXTS // 64, p, replace=False)) for p in pairs])
        n = len(contexts)
        values = (own, pairs.astype("<u4"), contexts.astype("<u4"), np.ones(n, "<u4"), (np.arange(n) % 1000).astype("<u2"), rng.integers(1, 3, n).astype("<u4"))
        for name, x in zip(("words", "pairs", "contexts", "entries", "docs", "counts"), values, strict=True):
            row[name].append(lm._pack(x))
    return row


def totals(b):
    tables = np.bincount(b.context, minlength=CONTEXTS)
    none = np.zeros((1, 0), np.int64)
    return lm.Totals(CONTEXTS, int(b.count.sum()), len(b.types), (0.7, 0.6), tables, tables[None], np.array([len(b.count)]), np.array([len(b.types)]), np.zeros(0, "<u8"), np.zeros(0, np.int64), none, none)


def test_a_bucket_holds_few_copies_of_its_pairs():
    row = bucket(40, 4000)
    none = np.zeros(0, "<u8")
    lm._seatings(0.7), lm._seatings(0.6)
    pairs = sum(len(lm._unpack(x, "<u4")) for x in row["contexts"])
    tracemalloc.start()
    b = lm._Bucket(row, CONTEXTS, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 56 * pairs, peak / pairs


def test_seats_are_those_drawn_for_all_pairs():
    b = lm._Bucket(bucket(3, 300), CONTEXTS, np.zeros(0, "<u8"))
    known = totals(b)
    first = next(lm._chain(b, known, 0, 1))[0]
    names = b.types[b.word] ^ (b.context + 1).astype("<u8") * np.uint64(0xD6E8FEB86659FD93)
    customers = np.bincount(b.word, np.minimum(b.count, 1), minlength=len(b.types)).astype(np.int64)
    base = (1 + 0.6 * known.root_tables.mean()) / (known.types + 1)
    root = lm._seat(customers, np.full(len(customers), base), 0.6, lm._uniform(b.types, 0))
    parent = (customers - 0.6 * root + base) / (1 + known.root_customers.mean())
    want = lm._seat(b.count, (1 + 0.7 * known.tables.mean(0))[b.context] * parent[b.word], 0.7, lm._uniform(names, 0))
    assert (first == want).all() and (first > 1).any()
