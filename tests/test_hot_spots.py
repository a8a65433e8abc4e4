"""Operators on crowded places: against plain loops, and within memory."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater import schema
from breakwater.operators import depth
from breakwater.params import Params
from breakwater.plans import complexes, evaluation


def aln(spark, *rows):
    """(read, flag, chrom, start, mapq, cigar)"""
    return spark.createDataFrame([(i, r, f, c, s, None, q, x, None, 100) for i, (r, f, c, s, q, x) in enumerate(rows)], schema.ALIGNMENTS)


def test_pileup_base_by_base(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        cigar = "".join(f"{rng.randint(0, 6)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.choice([1, 5, 64, 65, 200])))
        rows.append((f"r{i}", rng.choice([0, 16, 2048, 2064, 4, 256, 512, 1024]), rng.choice(["a", "b"]), rng.randint(0, 400), rng.choice([0, 8, 60, None]), cigar))
    rows += [("x", 0, "a", 5, 60, None), ("y", 0, None, 5, 60, "9M"), ("z", None, "a", 5, 60, "9M"), ("w", 0, "a", None, 60, "9M"), ("v", 0, "a", 3, 60, "*")]
    seen, good = Counter(), Counter()
    for _, flag, chrom, start, mapq, cigar in rows:
        if None in (flag, chrom, start, cigar) or flag & 1796:
            continue
        at, n = start, ""
        for x in cigar:
            if x.isdigit():
                n += x
                continue
            if x in "M=XDN":
                for p in range(at, at + int(n)):
                    seen[chrom, p] += 1
                    good[chrom, p] += x in "M=X" and mapq is not None and mapq >= 8
                at += int(n)
            n = ""
    for width in (7, 100, 10**6):
        runs = depth.pileup(aln(spark, *rows), 8, width).collect()
        got = {(r.chrom, p): (r.reads, r.depth) for r in runs for p in range(r.start, r.stop)}
        assert got == {k: (n, good[k]) for k, n in seen.items()} and sum(r.stop - r.start for r in runs) == len(got)
        ends = {(r.chrom, r.stop): (r.reads, r.depth) for r in runs}
        assert not any(ends.get((r.chrom, r.start)) == (r.reads, r.depth) for r in runs)  # the longest runs
    assert depth.pileup(aln(spark, *rows).limit(0)).collect() == []


def test_coverage_and_its_fallbacks(spark):
    contigs = spark.createDataFrame([(0, "a", 100_000), (1, "b", 900)], schema.CONTIGS)
    value = lambda *rows: depth.coverage(aln(spark, *rows), contigs, 30.0).first()["coverage"]
    deep = [(f"r{i}", (0, 2048)[i % 2], "a", 0, 60, "40000M20000D40000M") for i in range(4)]
    means = {r["sample"]: r["mean"] for r in depth.mean_depths(aln(spark, *deep), depth.sample_windows(contigs)).collect()}
    assert len(means) == 20 and means[0] == 4 and means[10] == 0  # deletions are columns without bases; supplementary ones count
    assert value(*deep) == 4
    assert value(*[("r", 0, "a", 0, 60, "3000M")] * 600) == 30.0  # one deep window, and no read near the quarter
    short = [("s", 0, "a", 30_000, 60, "10M")] * 600  # a window less than five, but 600 reads of 100 bases on 50,000 places
    assert value(*short) == 600 * 100 / 50_000
    assert value(*[(r, f, c, s, 9, x) for r, f, c, s, _, x in short]) == 30.0
    assert value() == 30.0
    capped = depth.mean_depths(aln(spark, *[("r", 0, "a", 900, 60, "3000M")] * 600), depth.sample_windows(contigs)).collect()
    assert [r["mean"] for r in capped] == [500.0]


def plain_events(calls, p):
    """Neighbours and shared reads call by call."""
    out, taken = [], set()
    for i, (start, stop, reads, kind) in enumerate(calls):
        if i in taken:
            continue
        near = [i]
        for j in range(i + 1, len(calls)):
            gap = calls[j][0] - stop
            if gap <= p.complex_distance and (gap <= p.merge_distance or reads & calls[j][2]):
                near.append(j)
        n = Counter(r for j in near for r in calls[j][2])
        if len(near) >= 2 and sum(x >= 2 for x in n.values()) >= p.complex_reads:
            taken |= set(near)
            out.append((min(calls[j][0] for j in near), max(calls[j][1] for j in near), float(len(n)), sorted(n), [calls[j][3] for j in near]))
    return sorted(out)


@pytest.mark.parametrize(("merge", "seed"), [(1000, 1), (1000, 2), (300, 3), (0, 4), (2000, 5)])
def test_shared_reads_in_one_island(spark, merge, seed):
    rng = random.Random(seed)
    p = Params(complex_reads=3, merge_distance=merge)
    rows = sorted((s := rng.randint(0, 60_000), s + rng.choice([1, 50, 400, 5000]), frozenset(f"r{rng.randint(0, 80)}" for _ in range(rng.randint(0, 6))), f"K{i:03}") for i in range(300))
    calls = spark.createDataFrame([(i, "c", a, b, 30, k) for i, (a, b, _, k) in enumerate(rows)] + [(900, None, 1, 2, 3, "x"), (901, "d", None, 2, 3, "x"), (902, "d", 5, 6, None, "x")], "call_id long, chrom string, start long, stop long, mapq int, sv_type string")
    own = spark.createDataFrame([(i, x) for i, r in enumerate(rows) for x in r[2]] + [(900, "r1"), (901, "r1"), (3, None)], "call_id long, read_name string")
    events, reads = complexes.shared_read_events(calls, own, p)
    names = {}
    for r in reads.collect():
        names.setdefault(r.event, []).append(r.read_name)
    got = sorted((r.start, r.stop, r.support, sorted(names[r.event]), r.components) for r in events.collect())
    assert got == plain_events([(a, b, r, k) for a, b, r, k in sorted(rows, key=lambda r: (r[0], r[1], r[3]))], p) and len(got) > 3
    assert complexes.shared_read_events(calls.limit(0), own.limit(0), p)[0].collect() == []


def test_an_island_of_a_hundred_thousand_calls():
    rng = np.random.default_rng(1)
    n, each = 100_000, 20
    starts = np.sort(rng.integers(0, 20_000_000, n))
    stops = starts + rng.integers(1, 2000, n)
    stops[::100] += 3_000_000  # calls over a tenth of the island, of which few share enough
    at, read = np.repeat(np.arange(n), each), rng.integers(0, 1 << 60, n * each)
    read[rng.random(n * each) < 0.02] = rng.integers(0, 4000)
    order = np.lexsort((at, read))
    tracemalloc.start()
    found = list(complexes._anchors(starts, stops, at[order], read[order], Params(complex_reads=10**6)))
    assert found == [] and tracemalloc.get_traced_memory()[1] < 1_000_000_000
    tracemalloc.stop()


def plain_matches(truth, calls, distance=500, ratio=0.7):
    pairs = sorted((abs(s - t), i, j) for i, s, x in truth for j, t, y in calls if abs(s - t) <= distance and min(x, y) / max(x, y) >= ratio)
    met, used = {}, set()
    for _, i, j in pairs:
        if i not in met and j not in used:
            met[i] = j
            used.add(j)
    return met


@pytest.mark.parametrize("kind", ["crowd", "ladder", "spread"])
def test_matches_do_not_depend_on_bins(spark, kind):
    rng = random.Random(6)
    if kind == "crowd":  # all near all
        truth, calls = ([(i, rng.randint(0, 300), rng.randint(50, 90)) for i in range(n)] for n in (150, 170))
    elif kind == "ladder":  # every pair hangs on the one before it
        truth, calls = [(i, 1000 * i, 100) for i in range(120)], [(i, 1000 * i + 500, 100) for i in range(120)]
    else:
        truth, calls = ([(i, rng.randint(0, 60_000), rng.randint(50, 150)) for i in range(300)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame([(i, "c", "DEL", s, z) for i, s, z in rows], "id long, chrom string, sv_type string, start long, size long")
    want = plain_matches(truth, calls)
    for width in (1, 20_000, 10**6):
        got = evaluation.match(frame(truth), frame(calls), width=width).collect()
        assert {r.truth_id: r.call_id for r in got if r.state == "TP"} == want
        assert Counter(r.state for r in got) == Counter(TP=len(want), FN=len(truth) - len(want), FP=len(calls) - len(want))
    assert evaluation.match(frame(truth).limit(0), frame(calls).limit(0)).collect() == []
    nulls = frame(truth[:2]).withColumn("start", F.lit(None).cast("long"))
    assert {r.state for r in evaluation.match(nulls, frame(calls[:2])).collect()} == {"FP"}
