"""Operator 13: words grouped with their spelling variants, over forward and reversed sorted dictionaries.

A word is a maximal run of Latin letters, A-Z lower-cased; here and there one loses a letter (by a checksum of document and run). Words that
are long and frequent enough are the vocabulary. Two words are near if one letter more, less or other parts them.

One edit leaves a half intact. Of a pair whose shorter word has m letters, the first difference lies in its first half, and the words share
their last m - m//2 letters, or beyond, and they share their first m//2. So the vocabulary is laid out twice, sorted forward by what a word begins with
and reversed by what it ends with, once for the pairs in which the word is the shorter (or as long), once for those in which it is the longer.
Words with equal ends lie side by side, as a block, and only within blocks are words compared.

A block has the places [lo, hi) at which its pairs may first differ; what lies before and behind is shared. A block of over MOST words is
subdivided before it is dealt out: into the pairs that differ before the middle, which share more of the end, and those from the middle on,
which share more of the beginning. Blocks within MOST are subdivided in the same way in their task. As the first difference of a pair is one place, a pair
is found in one block only. A block of one place holds the words that are equal but for one letter (two, for the longer ones), which the
alphabet bounds; no limit drops a word, and no group is collected.

Edge cases: null and empty texts have no words; a null id counts as the empty text in the checksum; repeated rows count again; no row but the
vocabulary's is returned, and an empty table gives none; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

LETTERS = "a-zA-ZÀ-ÿ"
DAMAGED = 199
HELD = 200_000  # words counted at once in a task
MOST = 2048  # words of a block that a task takes whole
FEW = 6  # words of a block that are compared each with each
BLOCK = ["m", "lo", "hi", "head"]
FOUND = "word string, n_near long, form_n long, form string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]+").findall
    total: Counter[str] = Counter()
    sizes = lambda: pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
    for batch in batches:
        for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not text:
                continue
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for word, n in Counter(runs(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                h = zlib.crc32(word.encode(), start)
                if h % DAMAGED == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                total[word] += n
            if len(total) >= HELD:
                yield sizes()
                total.clear()
    yield sizes()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """word, n (occurrences) of all words of so many letters and occurrences. Counts are summed up in each task before words are dealt out."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(_counted, "word string, n long").where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """With head: what the words of a block share, the beginning first and then the end as the reversed dictionary has it."""
    prefix = F.substr("word", F.lit(1), F.col("lo"))
    suffix = F.reverse(F.substr("word", F.length("word") - F.greatest(F.col("m") - F.col("hi"), F.lit(0)) + 1))
    return rows.withColumn("head", F.concat(prefix, F.lit(" "), suffix))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.withColumn("part", F.explode(parts)).select("word", "n", "m", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi")))


def dictionaries(words: DataFrame) -> DataFrame:
    """word, n, m, lo, hi, head: each word in the forward and the reversed dictionary of the pairs with m letters in the shorter word."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = words.select("word", "n", m)
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    return _keyed(rows.withColumn("side", F.explode(sides)).select("word", "n", "m", F.col("side.lo").alias("lo"), F.col("side.hi").alias("hi")))


def _pairs(short: list[tuple], long: list[tuple], m: int, lo: int, hi: int) -> Iterator[tuple[tuple, tuple]]:
    """Near pairs of a block that first differ at a place within [lo, hi). Words are (text, n, bytes as a whole number)."""
    if not short or len(short) + len(long) < 2:
        return
    if len(short) + len(long) > FEW and hi - lo > 1:
        middle = (lo + hi) // 2
        for a, b, shared in ((lo, middle, lambda w: w[len(w) - m + middle :]), (middle, hi, lambda w: w[:middle])):
            parts: dict[str, tuple[list, list]] = {}
            for side, words in enumerate((short, long)):
                for w in words:
                    parts.setdefault(shared(w[0]), ([], []))[side].append(w)
            for one, other in parts.values():
                yield from _pairs(one, other, m, a, b)
        return
    for i, (u, _, x) in enumerate(short):
        for j in range(i + 1, len(short)):
            d = x ^ short[j][2]
            top = (d.bit_length() - 1) >> 3
            if d and top == ((d & -d).bit_length() - 1) >> 3 and lo <= m - 1 - top < hi:
                yield short[i], short[j]
        for v in long:
            at = lo
            while at < m and u[at] == v[0][at]:
                at += 1
            if at < hi and u[at:] == v[0][at + 1 :] and u[:lo] == v[0][:lo]:
                yield short[i], v


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows cut between blocks only."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            block = now["block"].to_numpy()
            others = np.flatnonzero(block != block[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield now.slice(0, cut)
            rest = now.slice(cut)
    if rest is not None:
        yield rest


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of a block: how many near words the block has, and the one of largest n (ties: smallest)."""
    for run in _scanned(batches):
        best: dict[str, list] = {}
        blocks: dict[tuple, tuple[list, list]] = {}
        for word, n, *at, head in zip(*(run[c].to_pylist() for c in ("word", "n", "m", "lo", "hi", "head")), strict=True):
            w = (word, n, int.from_bytes(word.encode("latin-1"), "big"))
            blocks.setdefault((*at, head), ([], []))[len(word) - at[0]].append(w)
        for (m, lo, hi, _), (short, long) in blocks.items():
            for u, v in _pairs(short, long, m, lo, hi):
                for w, other in ((u, v), (v, u)):
                    now = best.setdefault(w[0], [0, -1, ""])
                    now[0] += 1
                    if (-other[1], other[0]) < (-now[1], now[2]):
                        now[1:] = other[1], other[0]
        yield pa.RecordBatch.from_pydict({"word": pa.array(best.keys(), pa.string()), **{c: pa.array([b[k] for b in best.values()], t) for k, (c, t) in enumerate((("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())))}})


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, form, form_n: of words that have near ones, how many, and the one of largest n. words: a stored table of word, n."""
    done, parts, now = [], [], stored(dictionaries(words), "spelling-blocks")
    while True:
        parts.append(now)
        large = now.where(F.col("hi") - F.col("lo") > 1).groupBy(*BLOCK).agg(F.count("*").alias("size")).where(F.col("size") > most).drop("size")
        large = stored(large, "spelling-large")
        parts.append(large)
        if large.isEmpty():
            break
        done.append(now.join(large, BLOCK, "left_anti"))
        now = stored(_halves(now.join(large, BLOCK, "left_semi")), "spelling-blocks")
    for d in done:
        now = now.unionByName(d.select(now.columns))
    block = F.xxhash64(*BLOCK)  # neighbouring blocks of one number are told apart in their task
    dealt = now.withColumn("block", block).repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK)
    best = F.min_by(F.struct("form", "form_n"), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("at"))).alias("f")
    found = stored(dealt.mapInArrow(_near, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "spelling-near")
    discard(words.sparkSession, *parts)
    return found.select("word", "n_near", "f.form", "f.form_n")


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow a word's form. links: a stored table of word, form. Every turn doubles the steps, and n grows
    fivefold with each, so few turns follow all."""
    now = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        after = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "spelling-roots")
        discard(links.sparkSession, now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: the whole vocabulary with each word's form, its near word of largest n (ties: the smallest) if that is at least
    `times` its own n, and the last form behind it."""
    words = stored(vocabulary(docs, id_col, text_col, least_letters, least_count), "spelling-words")
    near = near_words(words)
    kept = F.col("form_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    discard(docs.sparkSession, words)
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The same from the texts alone: crc32 by its definition (polynomial 0xEDB88320), near words by all words less one letter.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, c)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
cnt AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM cnt),
bytes AS (SELECT doc_id, run, n, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM hexed),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda a, c: xor(t[(xor(a, c) & 255) + 1], a >> 8), 4294967295), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
voc AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS (SELECT word, n, i, word[:i] || word[i + 2:] AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM voc)),
pairs AS (SELECT a.word AS w, a.n AS wn, b.word AS o, b.n AS "on" FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM less a JOIN voc v ON v.word = a.d UNION SELECT v.word, v.n, a.word, a.n FROM less a JOIN voc v ON v.word = a.d),
best AS (SELECT w, count(*) AS n_near, arg_min(o, (-"on", o)) AS o, max("on") AS "on" FROM pairs GROUP BY 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN "on" >= 5 * v.n THEN o END AS form, CASE WHEN "on" >= 5 * v.n THEN "on" END AS form_n FROM voc v LEFT JOIN best ON w = v.word),
walk AS (SELECT word, word AS at, form AS nxt FROM forms UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.nxt)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.nxt IS NULL"""
