"""Operator 1: quality of documents by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (log, square-root and arcsine scales bring them near the normal shape that the
discriminant assumes). Training sums counts, vectors and outer products per class over all labelled rows outside the held-out class, so it
takes no sample and the driver sees 2 x (1 + d + d^2) numbers at any size. A class covariance is shrunk towards the pooled one and that
towards a multiple of the identity. Scores come from the difference of log densities: Mahalanobis distances by forward substitution with
the Cholesky factors, which are computed once and sent with the task.

Neither labels nor lang, source or doc_id enter a score. score is the posterior of label 1 with the log odds divided by `temper`, as the
statistics are not independent enough for the plain posterior to be more than 0 or 1.

Edge cases: null and empty texts have all statistics at zero and are scored like any other; repeated rows are scored (and learnt from)
each; labels whose id or quality is null, or quality neither 0 nor 1, teach nothing; a null doc_id counts as the empty text in the split
and meets no label; with fewer than two classes to learn from every score is the share of label 1 in training (0.5 without any); an
empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checksum_class, stored

FEATURES = (
    "words", "letters_a_word", "spread_of_letters", "variety", "commonest_word", "word_again", "capitals", "capital_words", "odd_marks",
    "marked_words", "shouts", "stops", "digits", "lines_again", "words_a_line", "pairs_again", "vowels",
)
D = len(FEATURES)
ODD = "#$%&*+/<=>@\\^_`{|}~"
VOWELS = "aeiouáéíóúäöüèêà"
MARKED = re.compile(r"[^\w\s.,;:!?'\"()\-][.,;:]?$")


def _share(n: float, of: float) -> float:
    """The arcsine scale of a share, which keeps the differences near 0 and 1 that matter."""
    return math.asin(math.sqrt(min(1.0, n / of))) if of else 0.0


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """A class for each character of the basic plane: bits for letter, upper case, digit, odd mark, vowel. Others have none."""
    chars = [chr(c) for c in range(1 << 16)]
    bits = [[c.isalpha() for c in chars], [c.isupper() for c in chars], [c.isdigit() for c in chars], [c in ODD for c in chars], [c.lower() in VOWELS for c in chars]]
    out = sum(np.array(b, np.uint8) << k for k, b in enumerate(bits))
    out[-1] = 0
    return out


def _census(text: str) -> list[int]:
    """Letters, upper-case letters, digits, odd marks and vowels of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    by_kind = np.bincount(_kinds()[np.minimum(points, (1 << 16) - 1)], minlength=32)
    return [int(by_kind[np.arange(32) >> k & 1 == 1].sum()) for k in range(5)]


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * D
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(map(str.lower, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters, upper, digits, odd, vowels = _census(text)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        math.log(sizes.mean()),
        math.log1p(sizes.std()),
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        _share(max(counts.values()), n) if n > 1 else 0.0,
        _share(again, n),
        _share(upper, letters),
        _share(sum(map(str.isupper, words)), n),
        _share(odd, len(text)),
        _share(sum(1 for w in words if MARKED.search(w)), n),
        _share(text.count("!") + text.count("?"), n),
        _share(text.count(".") + text.count(","), n),
        _share(digits, len(text)),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)),
        _share(n - 1 - pairs, n),
        _share(vowels, letters),
    ]


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_class: int = 0) -> DataFrame:
    """doc_id, held_out, stats of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.array([statistics(t.as_py()) for t in b.column(1)], np.float64).reshape(-1)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * D), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), stats], ["doc_id", "held_out", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (checksum_class(id_col, modulus) == held_class).alias("held_out"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, stats array<double>")


def _matrix(stats: pa.ListArray) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and outer products of each class, as (quality, place, value) rows of one task."""
    total = np.zeros((2, 1 + D + D * D))
    for b in batches:
        x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            z = x[y == k]
            total[k] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
    n = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(2, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), 2)), pa.array(total.ravel())], ["quality", "place", "value"])


@dataclass(frozen=True)
class Discriminant:
    prior: float
    means: np.ndarray | None
    factors: np.ndarray | None  # lower Cholesky factors of the two covariances
    scale: np.ndarray | None
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, low in zip(self.means, self.factors, strict=True):
            z = ((x - mean) / self.scale).T
            for j in range(D):  # forward substitution, for all rows at once
                z[j] = (z[j] - low[j, :j] @ z[:j]) / low[j, j]
            logs.append(-0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum())
        odds = (logs[1] - logs[0] + math.log(self.prior / (1 - self.prior))) / self.temper
        return 1 / (1 + np.exp(np.clip(-odds, -700, 700)))


def discriminant(moments: np.ndarray, to_pooled: float, to_identity: float, temper: float) -> Discriminant:
    """moments: [2, 1 + d + d*d]."""
    n = moments[:, 0]
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return Discriminant(prior, None, None, None, temper)
    means = moments[:, 1 : 1 + D] / n[:, None]
    scatter = moments[:, 1 + D :].reshape(2, D, D) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / (n.sum() - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    unit = np.outer(scale, scale)
    out = []
    for k in (0, 1):
        own = ((1 - to_pooled) * scatter[k] / (n[k] - 1) + to_pooled * pooled) / unit
        own = (1 - to_identity) * own + to_identity * np.trace(own) / D * np.eye(D)
        out.append(np.linalg.cholesky(own))
    return Discriminant(prior, means, np.stack(out), scale, temper)


def fit(stats: DataFrame, labels: DataFrame, to_pooled: float = 0.8, to_identity: float = 0.01, temper: float = 4.0) -> Discriminant:
    """The discriminant of the labelled rows of vectors() that are not held out."""
    marks = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = stats.where(~F.col("held_out")).join(marks, "doc_id").select("stats", "quality")
    summed = known.mapInArrow(_moments, "quality int, place int, value double").groupBy("quality", "place").agg(F.sum("value").alias("value")).toPandas()
    moments = np.zeros((2, 1 + D + D * D))
    moments[summed["quality"], summed["place"]] = summed["value"]
    return discriminant(moments, to_pooled, to_identity, temper)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_class: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    stats = stored(vectors(docs, id_col, text_col, modulus, held_class), "quality-statistics")
    model = fit(stats, labels)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_class: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold. Their texts are read twice, to learn and to score, and never shuffled."""
    model = fit(stored(vectors(docs, id_col, text_col, modulus, held_class), "quality-statistics"), labels)
    place = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t.as_py()) for t in b.column(place)], np.float64).reshape(-1, D)
            yield b.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(of, docs.schema)
