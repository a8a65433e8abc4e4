"""The exact search beside the keys of near-duplicate texts: against all pairs, with the keys and without them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from breakwater.llm import similar_text
from breakwater.llm.simhash import shingle_hashes

DOCS = "/root/testdata/sf0.1/documents.parquet"


def smallest(sets, similarity=0.8):
    """Of each node the smallest of its component, by all pairs."""
    low = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and low[a] != low[b] and similar_text.jaccard(sets[a], sets[b]) >= similarity:
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {k: new if v == old else v for k, v in low.items()}
    return {k: v for k, v in low.items() if k != v}


def test_a_pair_without_a_common_key(spark):
    docs = spark.read.parquet(DOCS).where("doc_id IN (0, 6173)")
    soft = [np.unique(shingle_hashes(r.text, 5)) for r in docs.select("text").collect()]
    keys = [set(similar_text.soft_keys(similar_text.soft_bits(x)[None])[0].tolist()) for x in soft]
    assert similar_text.jaccard(*soft) > 0.8 and not keys[0] & keys[1]
    assert [tuple(r) for r in similar_text.groups(docs)[1].select("u", "v").collect()] == [(6173, 0)]


@pytest.mark.parametrize("share", [4096, 8])
def test_all_pairs_without_any_proposal(spark, monkeypatch, share):
    monkeypatch.setattr(similar_text, "_nearest", lambda batches: (b for b in batches if b is None))  # reads all, proposes nothing
    monkeypatch.setattr(similar_text, "SHARE", share)
    rng = random.Random(share)
    words = [f"w{i}" for i in range(3000)]
    notice = rng.choices(words, k=60)  # in most texts, so its shingles are frequent
    texts = []
    for family in range(12):
        base = rng.choices(words, k=rng.choice([7, 40, 90, 200]))
        for _ in range(8):
            made = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                made[rng.randrange(len(made))] = rng.choice(words)
            texts.append(" ".join((notice if family % 3 else []) + made))
    texts += ["", "one", "two words", " ".join(notice)]
    sets = {i: np.unique(shingle_hashes(t, 5)) for i, t in enumerate(texts) if t not in texts[:i]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.u: r.v for r in similar_text.groups(docs)[1].collect()}
    assert got == smallest(sets) and len(got) > 20


def test_a_prefix_is_shared_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype("<u8"))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 5)).astype("<u8"))))
        last = rng.permutation(a)[: len(a) // 2]
        rank = np.argsort(last)
        if similar_text.jaccard(a, b) >= 0.8:
            assert np.intersect1d(*(similar_text.prefix(x, 0.8, last[rank], rank) for x in (a, b))).size


def test_large_units_give_all_pairs():
    size = np.array([1, 3, 700, 2])
    start = np.cumsum(size) - size
    cells = [np.stack(c, 1) for c in similar_text._cells(start, size)]
    want = sum(int(n) ** 2 for n in size if n > 1)
    assert len(np.unique(np.concatenate(cells), axis=0)) == sum(map(len, cells)) == want


def test_a_pair_is_passed_on_where_it_first_meets():
    """Two texts that share 300 prefix shingles, one a batch as if dealt to tasks of their own: not a row for each."""
    counts = [bytes([32] * similar_text.COUNTS)] * 2

    def batches():
        for k in range(1, 301):
            before = {f"earlier{x}": [max(0, k - 1 - x)] * 2 for x in range(4)}
            row = {"unit": [k] * 2, "node": [1, 2], "label": [1, 2], "n": [2048] * 2, "place": [k - 1] * 2, **before, "counts": counts}
            yield pa.RecordBatch.from_pydict(row)

    made = [r for b in similar_text._candidates(0.8)(batches()) for r in b.to_pylist()]
    assert [(r["u"], r["v"]) for r in made] == [(2, 1)]


def test_places_and_earlier_keys_leave_no_pair_out():
    rng = np.random.default_rng(11)
    sets, want = [], set()
    for _ in range(60):
        base = rng.integers(1, 1 << 62, rng.integers(1, 80))
        sets += [np.unique(np.concatenate((base[rng.random(len(base)) < 0.95], rng.integers(1, 1 << 62, rng.integers(0, 8))))).astype("<u8") for _ in range(3)]
    sets = [x for x in sets if len(x)]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if similar_text.jaccard(sets[i], sets[j]) >= 0.8}
    rows = []
    for i, x in enumerate(sets):
        first = similar_text.prefix(x, 0.8, np.zeros(0, "<u8"), np.zeros(0, np.int64))
        counts = np.bincount((x >> np.uint64(58)).astype(int), minlength=similar_text.COUNTS).astype(np.uint8).tobytes()
        for k, key in enumerate(first):
            before = {f"earlier{y}": int(first[k - 1 - y]) if k > y else 0 for y in range(4)}
            rows.append({"unit": int(key), "node": i, "label": i, "n": len(x), "place": k, **before, "counts": counts})
    rows.sort(key=lambda r: r["unit"])
    made = [r for b in similar_text._candidates(0.8)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert len(want) > 40 and want <= {(r["u"], r["v"]) for r in made}
    for r in made:
        a, b = (similar_text.prefix(sets[r[x]], 0.8, np.zeros(0, "<u8"), np.zeros(0, np.int64)) for x in ("u", "v"))
        assert (r["u"], r["v"]) not in want or len(np.intersect1d(a, b)) >= r["need"]
