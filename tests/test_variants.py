"""Hand cases of the rules, and the sources' round trips."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from breakwater import params, schema
from breakwater.operators import depth, intervals, sequences
from breakwater.plans import caller, calls, complexes, evaluation, evidence, genotyping, scoring
from breakwater.sources import alignments, metrics, reference, variants
from breakwater.streaming.depth import window_counts

P = params.Params()


def aln(spark, *rows):
    """(read, flag, chrom, start, stop, mapq, cigar, sa)"""
    return spark.createDataFrame([(i, *r, 100) for i, r in enumerate(rows)], schema.ALIGNMENTS)


def ev(spark, *rows):
    """(ev_type, sv_type, start, size, read)"""
    return spark.createDataFrame([(t, k, "chr1", s, s + z, z, r, 60, False, None, None, None, None, i, 1) for i, (t, k, s, z, r) in enumerate(rows)], schema.EVIDENCE)


@pytest.mark.parametrize(
    ("cigar", "flag", "mapq", "want"),
    [
        ("10S90=60D40=50I100=", 0, 60, [("DEL", 1090, 1150, 60), ("INS", 1190, 1190, 50)]),
        ("100M14D100M49I", 0, 60, []),
        ("100M15D100M", 0, 60, [("DEL", 1100, 1115, 15)]),
        ("10S90=60D40=50I100=", 0, 29, []),
        ("10S90=60D40=50I100=", 2048, 60, []),
        (None, 0, 60, []),
        ("*", 0, 60, []),
    ],
)
def test_cigar(spark, cigar, flag, mapq, want):
    reads = evidence.usable(aln(spark, ("r", flag, "chr1", 1000, 1300, mapq, cigar, None)))
    assert sorted((r.sv_type, r.start, r.stop, r.size) for r in evidence.from_cigar(reads, P).collect()) == want


@pytest.mark.parametrize(
    ("sa", "want"),
    [
        ("chr2,501,+,50M,60,0;", ("BND", 2000, 2000, 0, "chr2", 500)),
        ("chr1,5001,-,50M,60,0;", ("INV", 1000, 5000, 4000, None, None)),
        ("chr1,2041,-,50M,60,0;", None),
        ("chr1,7001,+,50M,60,0;", None),
        ("chr1,7002,+,50M,60,0;", ("DUP", 1000, 7001, 1000, None, None)),
        ("chr2,501,+,50M,29,0;", None),
        ("chr2,x,+,50M,60,0;;chr2,1", None),
        ("", None),
        (None, None),
    ],
)
def test_supplementary(spark, sa, want):
    reads = evidence.usable(aln(spark, ("r", 0, "chr1", 1000, 2000, 0, "1000M", sa)))
    got = [(r.sv_type, r.start, r.stop, r.size, r.chr2, r.pos2) for r in evidence.from_supplementary(reads, P).collect()]
    assert got == ([want] if want else [])


def test_segments(spark):
    two = aln(spark, ("a", 0, "chr1", 100, 200, 60, "100M", None), ("a", 2048 + 16, "chr2", 150, 300, 50, "150M", None), ("b", 2048, "chr1", 100, 200, 60, "", None), ("b", 2048, "chr2", 150, 300, 60, "", None))
    more = aln(spark, ("c", 0, "chr1", 0, 200, 60, "", None), ("c", 2048, "chr1", 100200, 100300, 60, "", None), ("d", 0, "chr1", 0, 200, 60, "", None), ("d", 2048, "chr1", 100201, 100300, 60, "", None))
    got = [(r.read_name, r.ev_type, r.start, r.chr2, r.pos2, r.bnd_type, r.mapq) for r in evidence.from_segments(evidence.usable(two.unionByName(more))).collect()]
    assert sorted(got) == [("a", "SEGMENT_BND", 200, "chr2", 150, "N]", 50), ("d", "DISTANT_BND", 200, "chr1", 100201, None, 60)]


def test_far_copies_need_the_primary_first(spark):
    after = [("x", 0, "chr1", 0, 1000, 60, "", None), ("x", 2048, "chr1", 51001, 52000, 40, "", None)]
    assert [(r.start, r.stop, r.size, r.mapq) for r in evidence.from_far_copies(evidence.usable(aln(spark, *after))).collect()] == [(0, 52000, 1000, 40)]
    assert evidence.from_far_copies(evidence.usable(aln(spark, *after[::-1]))).count() == 0


@pytest.mark.parametrize("name", [None, "*"])
def test_nameless_alignments_make_no_pairs(spark, name):
    rows = evidence.usable(aln(spark, (name, 0, "chr1", 1000, 2000, 40, "1000M", None), (name, 2048, "chr1", 52_001, 52_500, 40, "499M", None), (name, 2048, "chr2", 1, 500, 40, "499M", None)))
    assert evidence.from_far_copies(rows).count() == 0 and evidence.from_segments(rows).count() == 0


def test_chains(spark):
    rows = ev(spark, ("CIGAR_DEL", "DEL", 100, 60, "a"), ("CIGAR_DEL", "DEL", 1100, 60, "b"), ("CIGAR_DEL", "DEL", 2101, 60, "c"), *(("X", "CPX", s, s * 7, "q") for s in (0, 70, 141)))
    got = {(r.sv_type, r.start): r.cluster for r in calls.clusters(rows, P).collect()}
    assert got == {("DEL", 100): 1, ("DEL", 1100): 1, ("DEL", 2101): 2, ("CPX", 0): 1, ("CPX", 70): 1, ("CPX", 141): 2}
    sizes = calls.clusters(ev(spark, ("CIGAR_DEL", "DEL", 100, 100, "a"), ("CIGAR_DEL", "DEL", 110, 50, "b")), P)
    assert sorted(r.cluster for r in sizes.collect()) == [1, 2]


def test_chain_over_ranges_is_one_chain(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "k", i * 10 + (500 if i > 30 else 0), i % 4) for i in range(400)] + [("one", 5, 5)] * 3, "key string, pos long, more long")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 2, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append(sorted(map(tuple, sequences.chain(rows, ["key"], "pos", ["more"], ["more"], lambda b: (F.col("pos") - b["pos"] > 100) | (b["more"] == 3), "g").collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] == found[3]
    want = []
    for key in (None, "k"):
        last, g = None, 0
        for pos, more in sorted((i * 10 + (500 if i > 30 else 0), i % 4) for i in range(400) if (i % 3 == 0) == (key is None)):
            g += last is None or pos - last[0] > 100 or last[1] == 3
            want.append((key, pos, more, g))
            last = pos, more
    assert found[0] == sorted([*want, *[("one", 5, 5, 1)] * 3], key=str)
    empty = sequences.chain(rows.limit(0), ["key"], "pos", [], [], lambda b: F.col("pos") > b["pos"], "g")
    assert empty.columns == [*rows.columns, "g"] and empty.collect() == []


def test_merge_and_numbers_over_bins(spark):
    flat = spark.createDataFrame([("k", i * 7, i * 7 + (300 if i % 10 == 0 else 3), "x") for i in range(80)], "chrom string, start long, stop long, info string")
    a, b = (sorted(map(tuple, sequences.merge(flat, ["chrom"], pad=1, label="info", width=w).collect())) for w in (10**9, 13))
    assert a == b
    assert [r.number for r in sequences.numbered(flat, "chrom", "start", [], width=50).orderBy("start").collect()] == list(range(1, 81))


def test_anchored_windows(spark):
    rows = spark.createDataFrame([("c", s) for s in (0, 500, 1000, 1001, 2001, 2002, 2002)], "chrom string, start long")
    got = sorted((r.start, r.anchor) for r in sequences.anchored(rows, "chrom", "start", 1000).collect())
    assert got == [(0, 0), (500, 0), (1000, 0), (1001, 1001), (2001, 1001), (2002, 2002), (2002, 2002)]
    one = ev(spark, ("CIGAR_DEL", "DEL", 0, 60, "r1"), ("CIGAR_INS", "INS", 900, 60, "r1"), ("CIGAR_INS", "INS", 5000, 60, "r1"), ("CIGAR_INS", "INS", 5001, 60, "r2"))
    assert [(r.start, r.components) for r in complexes.single_read_windows(one).collect()] == [(0, ["DEL", "INS"])]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("DEPTH_TANDEM", "DUP", 0, 100, "depth_1"), ("DEPTH_TANDEM", "DUP", 0, 100, "depth_2"), *(("SA_DUP", "DUP", 0, 100, f"r{i}") for i in range(3))], 13.0),
        ([("DEPTH_TANDEM", "DUP", 0, 100, "depth_1"), *(("SA_DUP", "DUP", 0, 100, f"r{i % 3}") for i in range(6))], 9.5),
        ([("SA_BND", "BND", 0, 0, "a"), ("SA_BND", "BND", 0, 0, "a"), ("SA_BND", "BND", 0, 0, "b")], 6.0),
    ],
)
def test_support(spark, rows, want):
    assert [r.support for r in calls.summed(calls.clusters(ev(spark, *rows), P), P).collect()] == [want]


def test_medians_are_truncated(spark):
    got = calls.summed(calls.clusters(ev(spark, ("CIGAR_DEL", "DEL", 10, 60, "a"), ("CIGAR_DEL", "DEL", 13, 60, "b")), P), P).first()
    assert (got.start, got.support, got.precise) == (11, 2.0, True)


@pytest.mark.parametrize(("af", "want"), [(2 / 30, "0/0"), (0.08, "0/1"), (0.55, "1/1")])
def test_genotype_of(spark, af, want):
    assert spark.range(1).select(genotyping.genotype_of(F.lit(af))).first()[0] == want


def call(spark, **kw):
    base = {"sv_type": "DEL", "support": 5.0, "af": 0.5, "qual": 50.0, "in_repeat": False, "source": "split_read", "depth_support": 0} | kw
    return spark.createDataFrame([tuple(base.values())], "sv_type string, support double, af double, qual double, in_repeat boolean, source string, depth_support long")


@pytest.mark.parametrize(
    ("kw", "want"),
    [
        ({"sv_type": "INS", "support": 4.0, "af": 0.3}, "MinSupport"),
        ({"sv_type": "DUP", "support": 2.0, "af": 0.1, "qual": 25.0}, "MinSupport"),
        ({"sv_type": "BND", "support": 1.0, "af": 0.01, "qual": 3.0}, "MinAF;LowQual"),
        ({"sv_type": "DUP", "support": 1.0, "af": 0.1, "qual": 25.0, "source": "depth", "depth_support": 3}, "PASS"),
        ({"sv_type": "INV", "support": 5.0, "in_repeat": True}, "MinSupport"),
        ({"sv_type": "DEL", "support": 1.0, "af": 0.006}, "PASS"),
    ],
)
def test_filters(spark, kw, want):
    assert scoring.with_filters(call(spark, **kw), P).first()["filter"] == want


@pytest.mark.parametrize(("f", "r", "want"), [(1, 19, 10.0), (2, 18, 30.0), (0, 0, 0.0)])
def test_strand_score(spark, f, r, want):
    assert spark.range(1).select(scoring.strand_score(F.lit(f), F.lit(r))).first()[0] == want


def test_intervals(spark):
    calls_ = spark.createDataFrame([(1, "c", 200, 250), (2, "c", 201, 250), (3, "c", 100, 100), (4, "d", 150, 160), (5, None, 1, 2)], "id int, chrom string, start long, stop long")
    rep = spark.createDataFrame([("c", 100, 200), ("c", 100, 200)], "chrom string, start long, stop long")
    assert {r.id for r in intervals.covered(calls_, rep, "chrom", ["id"], closed=True).where("covered").collect()} == {1, 3}
    assert {r.id for r in intervals.overlaps(calls_, rep, "chrom").collect()} == {3}
    merged = spark.createDataFrame([("c", 0, 600, "h"), ("c", 1000, 1600, "t")], "chrom string, start long, stop long, info string")
    assert [(r.start, r.stop, r.info) for r in sequences.merge(merged, ["chrom"], pad=500, label="info").collect()] == [(0, 1600, "repeat")]
    assert sequences.merge(merged, ["chrom"], pad=300, label="info").count() == 2


def test_trimmed_median(spark):
    assert depth.trimmed_median(spark.range(1, 11), "id").first()[0] == 5.5
    assert depth.trimmed_median(spark.range(1, 4), "id").first()[0] is None


def test_trimmed_median_sorts_all_rows_in_no_task(spark):
    rng = random.Random(4)
    for n in (5, 6, 99, 400):
        values = [rng.choice((rng.randrange(9), rng.random() * 1e6, -3)) * 1.0 for _ in range(n)]
        kept = sorted(values)[n // 5 : n - n // 5]
        got = depth.trimmed_median(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v")
        assert got.first()[0] == pytest.approx(statistics.median(kept))
    assert depth.trimmed_median(spark.createDataFrame([(7,)] * 9, "v long"), "v").first()[0] == 7
    keys = re.findall(r"windowspecdefinition\((\w+)", got._jdf.queryExecution().optimizedPlan().toString())
    assert keys and set(keys) <= {"_bin", "specifiedwindowframe"}


def test_vcf_fields(spark):
    def line(pos, alt, info, form="GT", sample="0/1", qual="5"):
        return ("\t".join(("chr1", str(pos), "x", "N", alt, qual, "PASS", info, form, sample)),)

    rows = [line(1, "<DUP:INT>", "SVTYPE=DUP;REPEAT=No"), line(0, "<DUP>", "SVTYPE=DUP;DUPTYPE=tandem;REPEAT=Yes"), line(5, "<DUP>", "SVTYPE=DUP;REPEAT=tandem;SVTYPE=DUP;FLAG", "GT:GQ", "1/0:5"), line(9, "<DEL>", "SVLEN=-77;SUPPORT=12.0;B=x=y", "GT:GQ", "0/1"), ("short\tline",), ("#head",)]
    got = variants.parsed(variants.split(spark.createDataFrame(rows, "value string"))).orderBy("pos").collect()
    assert [(r.pos, r.dup_subtype, r.in_repeat, r.repeat_type, r.gt_class) for r in got] == [(-1, "TANDEM", True, "Unknown", "het"), (0, "INTERSPERSED", False, None, "het"), (4, "TANDEM", True, "tandem", "het"), (8, None, False, None, "Unknown")]
    assert (got[3].type, got[3].size, got[3].support, got[0].key) == ("DEL", 77, 12.0, "chr1:-1:DUP")
    fixed = variants.repaired(spark.createDataFrame([line(1, "<DEL>", "A=1", qual=q) for q in (".", "5", "5.1", "abc")], "value string")).collect()
    assert [r.value.split("\t")[6] for r in fixed] == ["LowQual", "LowQual", "PASS", "LowQual"] and fixed[0].value.split("\t")[7] == "SVTYPE=DEL;A=1"


def test_sources(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:chr1\tLN:5000\n@SQ\tSN:chr2\tLN:900\nr1\t16\tchr1\t101\t60\t10S50M5D40M\t*\t0\t0\tACGT\t*\tSA:Z:chr2,1,+,5M,60,0;\nbad\tline\n")
    contigs, reads = alignments.read_sam(spark, str(tmp_path / "a.sam"))
    assert sorted(map(tuple, contigs.collect())) == [(0, "chr1", 5000), (1, "chr2", 900)]
    assert [(r.read_name, r.start, r.stop, r.sa, r.query_length) for r in reads.collect()] == [("r1", 100, 195, "chr2,1,+,5M,60,0;", 4)]
    (tmp_path / "a.fa").write_text(">chr1 first\nacgt\nACGT\n>chr2\nTT\n")
    assert sorted(map(tuple, reference.read_fasta(spark, str(tmp_path / "a.fa"), 6, 1).collect())) == [("chr1", 0, "ACGTACG"), ("chr1", 6, "GT"), ("chr2", 0, "TT")]
    (tmp_path / "a.bed").write_text("# c\nchr1\t1\t5\nchr1\t7\t9\thomopolymer\nchr1\tx\t9\n\n")
    assert sorted(map(tuple, reference.read_bed(spark, str(tmp_path / "a.bed")).collect())) == [("chr1", 1, 5, "tandem"), ("chr1", 7, 9, "homopolymer")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/summary.json").write_text('{"precision": null, "TP": 7}')
    got = metrics.read_summaries(spark, f"{tmp_path}/*/summary.json")
    assert [(r.caller, r.precision, r.tp) for r in got.collect()] == [("one", 0.0, 7)]
    assert metrics.summary_lines(got).first().value == "one,0.000,0.000,0.000,7,0,0"
    (tmp_path / "t.csv").write_text("Stage,Runtime_seconds,Memory_GB\nRun sniffles,10,1.5\nrun Sniffles,12,0\nother,1,1\n")
    assert [tuple(r) for r in metrics.read_runtimes(spark, str(tmp_path / "t.csv"), {"sniffles": "S"}).collect()] == [("S", 12, 1.5)]
    assert reference.wrapped(spark.createDataFrame([("c", "A" * 100)], "chrom string, seq string")).first().value == ">c\n" + "A" * 80 + "\n" + "A" * 20


def test_params():
    p, unused = params.from_json('"min_support_ins": 7, "min_af": 0.05,\n"expected_coverage": ${COVERAGE},', COVERAGE=12)
    assert p.min_support["INS"] == 7 and p.coverage == 12 and unused == ["min_af"]


def test_whole_caller_and_vcf(spark, tmp_path):
    rows = [(f"r{i}", 0 if i % 2 else 16, "chr1", 1000 + i, 4000, 60, f"{1000 - i}M60D1940M", None) for i in range(20)]
    contigs = spark.createDataFrame([(0, "chr1", 100_000)], schema.CONTIGS)
    repeats = spark.createDataFrame([], schema.REPEATS)
    found = caller.call_variants(aln(spark, *rows), contigs, repeats)
    got = found.collect()
    assert [(r.sv_type, r.start, r.stop, r.genotype, r["filter"]) for r in got] == [("DEL", 2000, 2060, "1/1", "PASS")]
    variants.write_vcf(found, str(tmp_path / "out.vcf"), contigs)
    lines = (tmp_path / "out.vcf").read_text().splitlines()
    assert lines[0] == "##fileformat=VCFv4.3" and "##contig=<ID=chr1,length=100000>" in lines
    assert [x for x in lines if not x.startswith("##")][0].split("\t")[:2] == ["#CHROM", "POS"] and sum("SVTYPE=DEL;END=2061;SVLEN=-60;SUPPORT=20" in x for x in lines) == 1
    assert caller.call_variants(aln(spark), contigs, repeats).count() == 0


def test_summary(spark):
    states = spark.createDataFrame([("c", "DEL", 1, 2, "TP"), ("c", "DEL", 3, None, "FN")], evaluation.STATES)
    assert tuple(evaluation.summary(states).first()) == (1, 0, 1, 1.0, 0.5, 2 / 3)
    assert tuple(evaluation.summary(states.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 09:00:00")], "key int, ts string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int, ts string").parquet(str(tmp_path / "in"))
    q = window_counts(stream, "key").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.start): r.n for r in spark.table("windows").collect()}
    assert got["2024-01-01 00:00:00"] == 2 and got["2024-01-01 00:15:00"] == 1


def test_homopolymers_beside_a_call(spark):
    """Twelve equal bases between 20 before the start and 20 after the stop count, in whatever chunk they lie."""
    seq = ["AC"[i % 2] for i in range(30_000)]
    for at in (9_995, 20_112, 25_000):
        seq[at : at + 12] = "T" * 12
    whole = "".join(seq)
    chunks = spark.createDataFrame([("chr1", s, whole[s : s + 10_100]) for s in range(0, 30_000, 10_000)], "chrom string, chunk_start long, seq string")
    rows = [("DEL", 9_000, 20_105, True), ("DEL", 10_027, 20_000, False), ("DEL", 10_020, 10_030, False), ("INS", 10_010, 10_010, True), ("DUP", 24_000, 26_000, True), ("INV", 3, 9_960, False), ("INV", 3, 9_986, False), ("INV", 3, 9_987, True)]
    made = spark.createDataFrame([(k, "chr1", a, z, False) for k, a, z, _ in rows], "sv_type string, chrom string, start long, stop long, is_complex boolean")
    none = spark.createDataFrame([], "chrom string, start long, stop long, info string")
    got = {(r.sv_type, r.start, r.stop): r.repeat_type for r in calls.with_repeats(made, none, chunks).collect()}
    assert got == {(k, a, z): "homopolymer" if is_in else None for k, a, z, is_in in rows}
