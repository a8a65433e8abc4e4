"""What findings of a review on larger tables asked for: plans and pieces that don't grow faster than their input, with the results of plain loops."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from breakwater import schema
from breakwater.functions import cigar
from breakwater.llm import sequences as sequences_op7
from breakwater.operators import depth, intervals, sequences
from breakwater.params import Params
from breakwater.plans import calls, catalogue, complexes, genotyping, reports

from test_hot_spots import plain_events

SF = "/root/testdata/sf0.001"
P = Params()


def test_chains_and_cluster_sums_pass_no_rows_to_python(spark, monkeypatch):
    made = []
    monkeypatch.setattr(sequences, "stored", lambda df, label, keep=sequences.stored: made.append(df) or keep(df, label))
    rows = catalogue.view(spark, SF, "ev").withColumn("components", F.expr("cast(null as array<string>)"))
    found = calls.summed(calls.clusters(rows, P), P)
    plans = [df._jdf.queryExecution().toString() for df in (*made, found)]
    assert len(plans) == 2 and not any(x in p for p in plans for x in ("MapInArrow", "MapInPandas", "distinct "))


def test_chains_go_on_over_ranges(spark):
    rng = random.Random(3)
    rows = [(k, p) for k in ("a", "b", None) for p in sorted(rng.sample(range(400), 120))] + [("c", 5)]
    want, last, n = [], None, 0
    for k, p in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        n = 1 if last is None or last[0] != k else n + (p - last[1] > 3)
        want.append((k or "", p, n))
        last = (k, p)
    got = sequences.chain(spark.createDataFrame(rows, "k string, p long").repartition(5), ["k"], "p", [], [], lambda before: F.col("p") - before["p"] > 3, "g")
    assert sorted((r.k or "", r.p, r.g) for r in got.collect()) == want


def test_events_from_small_blocks(spark):
    rng = random.Random(11)
    for merge in (1000, 300):
        p = Params(complex_reads=3, merge_distance=merge)
        rows = sorted((s := rng.randint(0, 40_000), s + rng.choice([1, 50, 400, 5000]), frozenset(f"r{rng.randint(0, 60)}" for _ in range(rng.randint(0, 6))), f"K{i:03}") for i in range(250))
        made = spark.createDataFrame([(i, "c", a, b, 30, k) for i, (a, b, _, k) in enumerate(rows)], "call_id long, chrom string, start long, stop long, mapq int, sv_type string")
        own = spark.createDataFrame([(i, x) for i, r in enumerate(rows) for x in r[2]], "call_id long, read_name string")
        got = complexes.shared_read_events(made, own, p, width=16)[0].collect()
        want = plain_events([(a, b, r, k) for a, b, r, k in sorted(rows, key=lambda r: (r[0], r[1], r[3]))], p)
        assert sorted((r.start, r.stop, r.support, r.components) for r in got) == [(a, b, n, k) for a, b, n, _, k in want] and len(want) > 3


def test_reads_around_calls_without_pairs(spark, monkeypatch):
    rng = random.Random(5)
    reads = [(rng.choice("ab"), s := rng.randint(0, 30_000), s + rng.choice([0, 10, 900, 6000]), rng.choice(["x", "y", "*", None, *"0123456789"])) for _ in range(150)]
    made = [(i, rng.choice("abc"), "DEL", s := rng.randint(0, 30_000), s + rng.choice([5, 2000, 20_000]), 1, 0.5, "split_read") for i in range(60)]
    own = sorted({(rng.randrange(60), rng.choice("0123456789xy")) for _ in range(150)})
    table = spark.createDataFrame([(c, a, b, n, True, 60) for c, a, b, n in reads], "chrom string, start long, stop long, read_name string, primary boolean, mapq int")
    calls_ = spark.createDataFrame(made, "call_id long, chrom string, sv_type string, start long, stop long, size long, af double, source string")
    contigs = spark.createDataFrame([(0, "a", 40_000), (1, "b", 25_000)], "ord int, chrom string, length long")
    pairs = []
    monkeypatch.setattr(genotyping.intervals, "overlaps", lambda left, right, *a, keep=intervals.overlaps, **k: pairs.append(right.count()) or keep(left, right, *a, **k))
    got = {r.call_id: (r.alt_support, r.ref_support) for r in genotyping.genotype(calls_, spark.createDataFrame(own, "call_id long, read_name string"), table, contigs, P).collect()}
    length = {"a": 40_000, "b": 25_000}
    for i, chrom, _, start, stop, *_ in made:
        mine = {n for c, n in own if c == i}
        a, b = (min(max(0, start - 1000), length[chrom] - 1), min(length[chrom], stop + 1000)) if chrom in length else (1, 0)
        near = {n for c, s, e, n in reads if c == chrom and s < b and max(e, s + 1) > a}
        assert got[i] == ((len(mine), len(near - mine)) if a < b else (0, 0))
    assert pairs and max(pairs) < len(reads)  # only reads with several alignments are met one by one


def test_covered_makes_no_pairs(spark):
    rng = random.Random(7)
    rows = lambda n: [(i, rng.choice("ab"), s := rng.randint(0, 500_000), s + rng.choice([-3, 0, 9, 5000, 300_000])) for i in range(n)]
    left, right = rows(80), rows(15)
    frame = lambda x: spark.createDataFrame([*x, (99, "a", None, 4), (98, None, 1, 4)], "id long, chrom string, start long, stop long")
    for more in (0, 1):
        found = intervals.covered(frame(left), frame(right), "chrom", ["id"], closed=bool(more))
        end = lambda s, e: max(e + more, s + 1)  # noqa: B023, E731
        assert {r.id for r in found.where("covered").collect()} == {i for i, c, s, e in left if any(c == d and s < end(t, u) and end(s, e) > t for _, d, t, u in right)}
        assert found.count() == 82 and "_abin" not in found._jdf.queryExecution().toString()


def test_medians_of_sizes_are_exact(spark):
    sizes = [1 + i * i % 99_991 for i in range(60_001)]
    frame = spark.createDataFrame([("DEL", None, n, "PASS") for n in sizes] + [("INS", None, 7, "PASS"), ("INS", None, 70_000_000, "PASS"), ("INV", None, 5, "PASS")], "sv_type string, dup_subtype string, size long, filter string")
    got = {(r.panel, r.side): (r.n, r.median) for r in reports.size_medians(frame, frame).collect()}
    want = {"DEL": (len(sizes), sorted(sizes)[(len(sizes) - 1) // 2]), "INS": (2, 7)}
    assert got == {(k, s): v for k, v in want.items() for s in ("truth", "detected")}


def test_masks_take_a_bit_a_place(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * (50 * i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    files = sequences_op7.write_sequences(docs, f"file://{tmp_path}/seq", length=1024)
    for f in files:
        made = sequences_op7.SequenceFile(f.path)
        rows = sum(made.reader.get_batch(k).num_rows for k in range(made.reader.num_record_batches))
        masks = [made.sequence(k)[1] for k in range(rows)]
        assert sum(int(m.sum()) for m in masks) == f.tokens and all(m.all() for m in masks[:-1]) and made.reader.schema.field("mask").type.value_type == pa.bool_()


def reads_of(rng, n, reach):
    return [(i, f"r{i}", 0, rng.choice("ab"), rng.randint(-50, reach), None, rng.choice([5, 60]), f"{rng.randint(1, 40)}M{rng.randint(0, 9)}D20M", None, 100) for i in range(n)]


def test_pileup_deals_changes_out_once(spark):
    rows = reads_of(random.Random(4), 400, 30_000)
    runs = depth.pileup(spark.createDataFrame(rows, schema.ALIGNMENTS), 8, 2000)
    seen, good = Counter(), Counter()
    for _, _, _, chrom, start, _, mapq, text, *_ in rows:
        m, d = (int(x) for x in text.split("D")[0].split("M"))
        for p in range(start, start + m + d + 20):
            seen[chrom, p] += 1
            good[chrom, p] += mapq >= 8 and not m <= p - start < m + d
    assert {(r.chrom, p): (r.reads, r.depth) for r in runs.collect() for p in range(r.start, r.stop)} == {k: (n, good[k]) for k, n in seen.items()}
    ran = runs._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert ran.count("MapInArrow") == 1 and ran.count("ReusedExchange") == 1  # reads are parsed once and their changes dealt out once
    assert "Aggregate" not in ran  # no task keeps a map of places, which spilled


def test_changes_are_summed_and_listed(spark):
    rows = reads_of(random.Random(6), 3000, 60_000)
    frame = spark.createDataFrame(rows, schema.ALIGNMENTS).selectExpr("chrom", "start", "cigar", "mapq >= 8 AS good").coalesce(1)
    found = {}
    for most in (1, 10**6):
        listed = cigar.depth_events(frame, 7000, most).toArrow().combine_chunks().to_batches()
        sums = Counter()
        for batch in listed:
            size = pa.compute.list_value_length(batch["gaps"]).to_numpy(zero_copy_only=False)
            assert 0 < size.min() and size.max() <= cigar.LISTED
            of = [(c, b) for c, b, n in zip(batch["chrom"].to_pylist(), batch["bin"].to_pylist(), size) for _ in range(n)]
            for (c, b), p, r, d in zip(of, *cigar.listed_places(batch)):
                assert 0 <= p < 7000
                sums[c, b * 7000 + int(p), "r"] += int(r)
                sums[c, b * 7000 + int(p), "d"] += int(d)
        found[most] = {k: n for k, n in sums.items() if n}
    assert found[1] == found[10**6] and len(found[1]) > 2 * cigar.LISTED
    same = spark.createDataFrame([("a", 9, "30M", True)] * 5000, "chrom string, start long, cigar string, good boolean").coalesce(1)
    assert cigar.depth_events(same, 1000).drop("chrom", "bin").collect() == [([9, 30], [5000, -5000], [5000, -5000])]  # one row for 5000 reads


def test_points_are_counted_by_blocks(spark):
    rng = random.Random(8)
    number = lambda: rng.randint(-40, 300)
    queries = [(i, rng.randint(1, 3), number(), number()) for i in range(200)]
    points = [(rng.randint(1, 4), number(), number(), rng.choice([None, number()])) for _ in range(400)]
    frames = spark.createDataFrame(queries, "id long, key long, low long, high long"), spark.createDataFrame(points, "key long, x long, y long, z long")
    want = {i: sum((y <= high) - (z is not None and z <= high) for k, x, y, z in points if k == key and x >= low) for i, key, low, high in queries}
    for width in (1, 16, 1000):
        got = intervals.contained(*frames, width).groupBy("id").agg(F.sum("n").alias("n")).collect()
        assert {r.id: r.n for r in got} == want
    assert intervals.contained(frames[0].limit(0), frames[1], 16).count() == 0
    assert intervals.contained(frames[0], frames[1].limit(0), 16).where("n <> 0").count() == 0


def test_long_calls_are_not_copied_to_all_blocks(spark, monkeypatch):
    made = []
    for module in (complexes, intervals):
        monkeypatch.setattr(module, "stored", lambda df, label, keep=sequences.stored: made.append(keep(df, label)) or made[-1], raising=False)
    rng = random.Random(12)
    p = Params(complex_reads=3)
    rows = sorted((s := rng.randint(0, 400_000), s + rng.choice([5, 700, 300_000, 400_000]), frozenset(f"r{rng.randint(0, 4000)}" for _ in range(3)), f"K{i:03}") for i in range(640))
    calls_ = spark.createDataFrame([(i, "c", a, b, 30, k) for i, (a, b, _, k) in enumerate(rows)], "call_id long, chrom string, start long, stop long, mapq int, sv_type string")
    own = spark.createDataFrame([(i, x) for i, r in enumerate(rows) for x in r[2]], "call_id long, read_name string")
    got = complexes.shared_read_events(calls_, own, p, width=16)[0].collect()
    want = plain_events(rows, p)
    assert sorted((r.start, r.stop, r.support, r.components) for r in got) == [(a, b, n, k) for a, b, n, _, k in want] and want
    assert max(df.count() for df in made) < 6 * len(rows)  # by blocks of 16 calls, each with all that come after it: 20 rows a call


def test_long_calls_and_reads_with_several_alignments(spark, monkeypatch):
    rng = random.Random(9)
    reads = [(s := rng.randint(0, 60_000), s + rng.choice([10, 900, 9000]), rng.choice("0123456789")) for _ in range(120)]
    made = [(i, "DEL", s := rng.randint(0, 50_000), s + rng.choice([5, 900, 40_000]), 1, 0.5, "split_read") for i in range(80)]
    table = spark.createDataFrame([("a", a, b, n, True, 60) for a, b, n in reads], "chrom string, start long, stop long, read_name string, primary boolean, mapq int")
    calls_ = spark.createDataFrame([(i, "a", *r) for i, *r in made], "call_id long, chrom string, sv_type string, start long, stop long, size long, af double, source string")
    monkeypatch.setattr(genotyping, "SHORT", 4000, raising=False)
    monkeypatch.setattr(genotyping, "WIDE", 3000)
    asked = []
    monkeypatch.setattr(genotyping.intervals, "overlaps", lambda left, right, *a, keep=intervals.overlaps, **k: asked.append(left) or keep(left, right, *a, **k))
    contigs = spark.createDataFrame([(0, "a", 70_000)], "ord int, chrom string, length long")
    got = {r.call_id: r.ref_support for r in genotyping.genotype(calls_, spark.createDataFrame([], "call_id long, read_name string"), table, contigs, P).collect()}
    assert got == {i: len({n for s, e, n in reads if s < stop + 1000 and e > max(0, start - 1000)}) for i, _, start, stop, *_ in made}
    assert all(r["_to"] - r["_from"] <= 4000 for df in asked for r in df.collect())  # only short calls are dealt to the places they lie on
