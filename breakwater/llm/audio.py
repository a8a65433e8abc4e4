"""Operator 6: chroma fingerprints of audio columns, and the alignment of recordings by them.

Frames of the samples become spectra, spectra twelve pitch classes of unit length. Over this image (frames by classes), sixteen filters are
rectangles' differences read off an integral image; each is quantised to two bits in Gray code, and the sixteen together are one packed
integer a place. Two recordings are aligned by the offset at which the most of their integers have their first ALIGN_BITS bits equal; the bits that differ there, over
the stretch they share, are its errors.

Recordings with one fingerprint are a class, named by its smallest id. Every other member has a row of rank 0 that names its class, so no group
of copies, however large, takes the places of others. The search takes a query set against all classes in blocks: every block of queries
meets every block of classes once (a cell), and a cell's work is a sorted lookup and a histogram of (query, candidate, offset). A cell passes
on k classes a query and heaps merge them. Blocks have about QUERY_INTS and CANDIDATE_INTS integers at every size. Where a recording has over
MANY equal places in a cell (silence, a held tone), its pairs are counted one by one, an integer that is frequent in both by convolution, so
memory is bounded by the recordings' lengths.

Fingerprints: WAV files are brought to RATE by averaging; a recording shorter than a whole image is padded with silence. Edge cases: null and
empty recordings have no integers and meet none; damaged WAV headers are read as raw samples at RATE; rows repeated whole are one recording; of rows with one id and
different sounds each is searched for and found, but a query's own id, where no other has that sound, is no match of it; rows with a null id are
fingerprinted but take no part in the search; ties go to the smaller id, and among offsets to the smallest; an empty table gives no rows; only
the id and audio columns are read.
"""

from __future__ import annotations

import heapq
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_runs, salted_join, stored

FRAME, HOP, RATE = 1024, 64, 8000  # bins of 7.8 Hz: a semitone at LOW is 11.9
SPAN = 16  # frames a packed integer sees
QUERY_INTS, CANDIDATE_INTS = 500_000, 1_000_000
LOW, HIGH = 200.0, 3520.0
STEP = 0.06  # quantiser: below -STEP, below 0, below STEP, above
GRAY = np.array([0, 1, 3, 2], np.uint32)
STRIP = 2048
ALIGN_BITS = 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters: each kind of difference at four places, sizes by turns."""
    return [(k % 4, (3 * k + k // 4) % 7, 4 + 2 * (k % 2), (16, 8, 12, 4)[k // 4]) for k in range(16)]


def resampled(sound: np.ndarray, rate: int, to: int) -> np.ndarray:
    """The sound at another rate: each new sample is the mean of the old ones over its time."""
    if rate == to or not len(sound):
        return sound
    sums = np.concatenate(([0.0], np.cumsum(sound, dtype=np.float64)))
    edges = np.minimum(np.arange(int(len(sound) * to / rate) + 1) * (rate / to), len(sound))
    return (np.diff(np.interp(edges, np.arange(len(sums)), sums)) * (to / rate)).astype(np.float32)


def samples(audio: bytes | None, kind: str = "wav", rate: int = RATE) -> np.ndarray:
    """Samples between -1 and 1. kind: wav, s16le or u8; channels of a WAV are averaged, and it is brought to `rate`."""
    if not audio:
        return np.zeros(0, np.float32)
    if kind == "wav":
        try:
            with wave.open(io.BytesIO(audio)) as w:
                width, channels, told, raw = w.getsampwidth(), w.getnchannels(), w.getframerate() or rate, w.readframes(w.getnframes())
        except (wave.Error, EOFError):
            width, channels, told, raw = 2, 1, rate, audio
        if width == 1:
            flat = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
        elif width == 2:
            flat = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
        else:
            top = np.frombuffer(raw[: len(raw) // width * width], np.uint8).reshape(-1, width)[:, -2:]
            flat = np.ascontiguousarray(top).view("<i2").ravel().astype(np.float32) / 32768
        return resampled(flat[: len(flat) // channels * channels].reshape(-1, channels).mean(1), told, rate)
    if kind == "s16le":
        return np.frombuffer(audio[: len(audio) // 2 * 2], "<i2").astype(np.float32) / 32768
    return (np.frombuffer(audio, np.uint8).astype(np.float32) - 128) / 128


def _classes(rate: int, frame: int) -> np.ndarray:
    """Which pitch class each bin of the spectrum belongs to, as a matrix."""
    hz = np.arange(frame // 2 + 1) * rate / frame
    real = (hz >= LOW) & (hz <= HIGH)
    out = np.zeros((len(hz), 12), np.float32)
    out[np.flatnonzero(real), np.rint(12 * np.log2(hz[real] / 440)).astype(int) % 12] = 1
    return out


def fingerprints_of(sounds: list[np.ndarray], rate: int = RATE, frame: int = FRAME) -> list[np.ndarray]:
    """The packed integers of each recording; the arithmetic runs over all of them at once."""
    frames = np.array([0 if not len(s) else max(SPAN, 1 + -(-max(0, len(s) - frame) // HOP)) for s in sounds], np.int64)
    if not frames.sum():
        return [np.zeros(0, np.uint32) for _ in sounds]
    room = np.where(frames > 0, (frames - 1) * HOP + frame, 0)
    at = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), np.float32)
    for s, a in zip(sounds, at.tolist(), strict=True):
        flat[a : a + len(s)] = s
    first = np.cumsum(frames) - frames
    owner = np.repeat(np.arange(len(sounds)), frames)
    starts = at[owner] + (np.arange(len(owner)) - first[owner]) * HOP
    window, classes = np.hanning(frame).astype(np.float32), _classes(rate, frame)
    image = np.empty((len(starts), 12), np.float32)
    views = np.lib.stride_tricks.sliding_window_view(flat, frame)
    for k in range(0, len(starts), STRIP):
        spectrum = np.fft.rfft(views[starts[k : k + STRIP]] * window)
        image[k : k + STRIP] = (spectrum.real**2 + spectrum.imag**2) @ classes
    image /= np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-6)
    integral = np.zeros((len(image) + 1, 13))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=integral[1:, 1:])
    count = np.maximum(frames - SPAN + 1, 0)
    of = np.repeat(np.arange(len(sounds)), count)
    place = first[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        top, end = integral[place + x0], integral[place + x1]
        return end[:, y1] - end[:, y0] - top[:, y1] + top[:, y0]

    packed = np.zeros(len(place), np.uint32)
    for kind, y, high, wide in filters():
        whole, half_x, half_y = area(0, wide, y, y + high), wide // 2, high // 2
        if kind == 0:  # classes against classes
            a = area(0, wide, y, y + half_y)
        elif kind == 1:  # earlier against later
            a = area(0, half_x, y, y + high)
        elif kind == 2:  # crosswise
            a = area(0, half_x, y, y + half_y) + area(half_x, wide, y + half_y, y + high)
        else:  # middle against the sides in time
            a = area(wide // 4, wide - wide // 4, y, y + high)
        value = np.log((1 + a) / (1 + whole - a))
        packed = packed << np.uint32(2) | GRAY[np.searchsorted([-STEP, 0.0, STEP], value)]
    return np.split(packed, np.cumsum(count)[:-1])


def fingerprint(recordings: DataFrame, id_col: str, audio_col: str, kind: str = "wav", rate: int = RATE, frame: int = FRAME) -> DataFrame:
    """id, fingerprint (packed little-endian unsigned 32-bit integers), n_ints of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = 0, b.column(1)
            while at < b.num_rows:  # as many recordings at once as make some million samples
                end, size = at, 0
                while end < b.num_rows and (end == at or size < 2_000_000):
                    size += raw[end].as_buffer().size + SPAN * HOP if raw[end].is_valid else 0
                    end += 1
                got = fingerprints_of([samples(raw[k].as_py(), kind, rate) for k in range(at, end)], rate, frame)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()), pa.array(list(map(len, got)), pa.int32())], ["id", "fingerprint", "n_ints"])
                at = end

    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("audio"))
    return rows.mapInArrow(of, "id long, fingerprint binary, n_ints int")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Bits that differ, and integers compared, where b's place is a's plus offset."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum(dtype=np.int64)), hi - lo


FOUND = "query_id long, id long, shift int, matches long, bits long, overlap int"
NAMES = [x.split()[0] for x in FOUND.split(", ")]
MATCHES, MANY = 1_000_000, 4_000_000


def _votes(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The most equal places of two sequences at one offset, and the smallest such offset."""
    total = np.zeros(len(a) + len(b) - 1, np.int64)  # by offset, from 1 - len(a)
    common = np.intersect1d(a, b)
    of_a, of_b = (np.searchsorted(common, x).clip(max=max(0, len(common) - 1)) for x in (a, b))
    real_a, real_b = (np.isin(x, common) for x in (a, b))
    n_a, n_b = np.bincount(of_a[real_a], minlength=len(common)), np.bincount(of_b[real_b], minlength=len(common))
    hot = n_a * n_b > 32 * len(total)
    room = 1 << int(len(total) - 1).bit_length()
    for k in np.flatnonzero(hot):
        in_a, in_b = (np.fft.rfft(real & (of == k), room) for real, of in ((real_a[::-1], of_a[::-1]), (real_b, of_b)))
        total += np.rint(np.fft.irfft(in_a * in_b, room)[: len(total)]).astype(np.int64)
    i = np.flatnonzero(real_a & ~hot[of_a]) if len(common) else np.zeros(0, np.int64)
    j = np.flatnonzero(real_b & ~hot[of_b]) if len(common) else np.zeros(0, np.int64)
    i = i[np.argsort(of_a[i], kind="stable")]
    first = np.searchsorted(of_a[i], of_b[j])
    n = np.searchsorted(of_a[i], of_b[j], side="right") - first
    for at in np.split(np.arange(len(j)), np.flatnonzero(np.diff(np.cumsum(n) // MATCHES)) + 1):
        m = n[at]
        hit = np.repeat(first[at], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        total += np.bincount(np.repeat(j[at], m) - i[hit] + len(a) - 1, minlength=len(total))
    best = int(total.argmax())
    return int(total[best]), best + 1 - len(a)


def _ints(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return rows["id"].to_numpy(), [np.frombuffer(x, "<u4") for x in rows["fingerprint"].to_pylist()]


def _cell(k: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q = _ints(left)
        c_ids, c = _ints(right)
        c_last = right["last"].to_numpy()
        best: list[list[tuple]] = [[] for _ in q]
        if len(q) and len(c):
            sizes = np.array(list(map(len, q)))
            ints = np.concatenate(q) >> np.uint32(32 - ALIGN_BITS)
            order = np.argsort(ints, kind="stable")
            ints, q_of = ints[order], np.repeat(np.arange(len(q)), sizes)[order]
            q_at = (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
            c_sizes = np.array(list(map(len, c)))
            wanted = np.concatenate(c) >> np.uint32(32 - ALIGN_BITS)
            a, z = np.searchsorted(ints, wanted), np.searchsorted(ints, wanted, side="right")
            ends = np.concatenate(([0], np.cumsum(c_sizes)))
            reach = np.add.reduceat(z - a, ends[:-1])
            for y in np.flatnonzero(reach > MANY).tolist():
                z[ends[y] : ends[y + 1]] = a[ends[y] : ends[y + 1]]
                for x in range(len(q)):
                    if q_ids[x] != c_ids[y] or q_ids[x] != c_last[y]:
                        votes, shift = _votes(q[x] >> np.uint32(32 - ALIGN_BITS), c[y] >> np.uint32(32 - ALIGN_BITS))
                        if votes:
                            best[x].append((-votes, int(c_ids[y]), shift, y))
            reach[reach > MANY] = 0
            cuts = np.flatnonzero(np.diff(np.cumsum(reach) // MATCHES)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True):
                s = slice(ends[lo], ends[hi])
                n = z[s] - a[s]
                from_c = np.repeat(np.arange(s.start, s.stop), n)
                hit = np.repeat(a[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cand = np.searchsorted(ends, from_c, side="right") - 1
                shift = from_c - ends[cand] - q_at[hit]
                query = q_of[hit]
                other = (q_ids[query] != c_ids[cand]) | (q_ids[query] != c_last[cand])
                triples = np.stack((query[other], cand[other], shift[other]), 1)
                if not len(triples):
                    continue
                order = np.lexsort((triples[:, 2], triples[:, 1], triples[:, 0]))
                triples = triples[order]
                new = np.flatnonzero(np.concatenate(([True], (triples[1:] != triples[:-1]).any(1))))
                votes, triples = np.diff(np.append(new, len(order))), triples[new]
                order = np.lexsort((triples[:, 2], -votes, triples[:, 1], triples[:, 0]))  # of a pair, the offset with most votes
                votes, triples = votes[order], triples[order]
                top = np.concatenate(([True], (triples[1:, :2] != triples[:-1, :2]).any(1)))
                votes, triples = votes[top], triples[top]
                order = np.lexsort((c_ids[triples[:, 1]], -votes, triples[:, 0]))
                votes, triples = votes[order], triples[order]
                for nth in np.flatnonzero(np.arange(len(order)) - np.searchsorted(triples[:, 0], triples[:, 0]) < k).tolist():
                    x, y, shift_of = triples[nth].tolist()
                    best[x].append((-int(votes[nth]), int(c_ids[y]), shift_of, y))
                    if len(best[x]) > 8 * k:
                        best[x] = heapq.nsmallest(k, best[x])
        rows: list[tuple] = []
        for x, found in enumerate(best):
            for votes, i, shift_of, y in heapq.nsmallest(k, found):
                rows.append((int(q_ids[x]), i, shift_of, -votes, *bit_errors(q[x], c[y], shift_of)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], NAMES)

    return of


def _merge(k: int, most_errors: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "query_id"):
            by_query: dict[int, list[tuple]] = {}
            for row in zip(*(t[n].to_pylist() for n in NAMES), strict=True):
                by_query.setdefault(row[0], []).append((-row[3], row[1], *row[2:]))
            rows: list[tuple] = []
            for query, found in by_query.items():
                for rank, (_, i, shift, votes, bits, overlap) in enumerate(heapq.nsmallest(k, found), 1):
                    rate = bits / (32 * overlap) if overlap else 1.0
                    rows.append((query, rank, i, shift, votes, overlap, bits, rate, rate <= most_errors))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ALIGNED_NAMES)

    return of


ALIGNED = "query_id long, rank int, match_id long, offset int, matches long, overlap int, bit_errors long, error_rate double, aligned boolean"
ALIGNED_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]


def align(prints: DataFrame, modulus: int = 50, k: int = 20, most_errors: float = 0.25) -> DataFrame:
    """prints: id, fingerprint, n_ints. For each row whose id is divisible by modulus, the k classes with the most equal places at one
    offset (in integers, the match's place less the query's), with the bit errors there; its own class, if it has other members, is one of them.
    And for each row whose id isn't the smallest of its class, a row of rank 0 with that one. Classes without an equal place don't appear."""
    known = prints.where("id IS NOT NULL AND n_ints > 0").select("id", "fingerprint", "n_ints", F.unhex(F.md5("fingerprint")).alias("digest"))
    rows = stored(known, "audio-prints")
    of_class = rows.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("fingerprint").alias("fingerprint"), F.first("n_ints").alias("n_ints"))
    classes = stored(of_class, "audio-classes")
    asks = F.pmod("id", F.lit(modulus)) == 0
    ints, asked = (df.agg(F.sum("n_ints")).first()[0] or 0 for df in (classes, rows.where(asks)))
    down, across = max(1, -(-ints // CANDIDATE_INTS)), max(1, -(-asked // QUERY_INTS))

    def dealt(df: DataFrame, name: str, blocks: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "digest"), F.lit(blocks)).cast("int")
        return df.withColumn(name, mine).drop("digest", "n_ints").withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    queries = dealt(rows.where(asks).dropDuplicates(["id", "digest"]), "across", across, "down", down)
    met = queries.groupBy("across", "down").cogroup(dealt(classes, "down", down, "across", across).groupBy("across", "down")).applyInArrow(_cell(k), FOUND)
    found = met.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k, most_errors), ALIGNED)
    named = salted_join(rows.select("digest", "id", "n_ints"), classes.where("last > id").select("digest", F.col("id").alias("match_id")), "digest", "id").where("id <> match_id").distinct()
    full = F.col("n_ints").cast("long").alias("matches")
    members = named.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "match_id", F.lit(0).alias("offset"), full, F.col("n_ints").alias("overlap"), F.lit(0).cast("long").alias("bit_errors"), F.lit(0.0).alias("error_rate"), F.lit(True).alias("aligned"))
    return found.unionByName(members)
