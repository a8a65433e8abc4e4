"""Spelling variants against brute force, with nulls, empty and very long texts, repeated rows, clashing columns and blocks that must be subdivided."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breakwater.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(u, v):
    """One code point inserted, deleted or replaced."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows, letters=6, least=5, times=5):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= letters and n >= least}
    met = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: min(m, key=lambda x: (-words[x], x)) for w, m in met.items() if m}
    form = {w: f for w, f in form.items() if words[f] >= times * words[w]}
    out = set()
    for w in words:
        last = w
        while last in form:
            last = form[last]
        out.add((w, form.get(w), last, words[w], len(met[w]), words[form[w]] if w in form else None))
    return out


def plain(df):
    return {tuple(None if pd.isna(x) else x for x in r) for r in df.toPandas()[COLUMNS].itertuples(index=False)}


def typos(seed, words, n):
    """Words drawn unevenly, some with one edit."""
    rng = np.random.default_rng(seed)
    out = []
    for k in rng.zipf(1.3, n):
        w = words[k % len(words)]
        if rng.random() < 0.3:
            i, kind, c = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3)), "abéÿz"[int(rng.integers(0, 5))]
            w = w[:i] + c + w[i:] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + c + w[i + 1 :]
        out.append(w)
    return " ".join(out)


WORDS = ["accommodate", "separate", "aaaaaaaa", "aaaaaaab", "strasse", "Éclairée", "banana", "bananas", "a" * 40, "letter×sign", "x" * 6]


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " \n", "ÀÉÿ", "Seperate SEPARATE separate" * 3, typos(1, WORDS, 6000), typos(2, WORDS, 300), typos(2, WORDS, 300), "banana-banana_banana " * 20, "chainaaa " * 6 + "chainaab " * 40 + "chainabb " * 250]
    return [*enumerate(texts), (None, typos(3, WORDS, 200)), (None, None), (5, typos(1, WORDS, 6000))]


def test_against_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "m", "lo", "hi", "head", "block", "form", "root")})
    want = brute(rows)
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f and r != f for _, f, r, *_ in want)
    assert plain(spelling.variants(docs)) == want
    assert spelling.variants(docs.limit(0)).collect() == []


def test_every_block_subdivided(spark, rows):
    """With three words a block at most, all blocks are halved until one place is left, and no pair is lost or found twice."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.stored(spelling.vocabulary(docs), "words")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(words, most=3).collect()}
    assert got == {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(words).collect()}
    sizes = {w: n for w, _, _, n, _, _ in brute(rows)}
    assert {w: g[0] for w, g in got.items()} == {w: m for w, m in ((w, sum(near(w, x) for x in sizes)) for w in sizes) if m}


def test_shared_half(spark):
    """Two thousand words with one beginning: a block that holds all of them."""
    rng = np.random.default_rng(5)
    words = sorted({"prefix" + "".join(rng.choice(list("abcdé"), 5)) for _ in range(2000)})
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(6)], "doc_id long, text string")
    assert plain(spelling.variants(docs)) == brute([(i, " ".join(words)) for i in range(6)])


def test_the_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {tuple(None if pd.isna(x) else x for x in r) for r in db.execute(spelling.ORACLE).df()[COLUMNS].itertuples(index=False)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert plain(spelling.variants(docs)) == want == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
