"""Files in many parts, sequences of any length, VCF files by the format's rules, and the report tables."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater.functions import variant_fields
from breakwater.plans import reports
from breakwater.sources import alignments, lines, metrics, reference, tables, variants

CALL = "caller string, sv_type string, size long, filter string, in_repeat boolean, dup_subtype string, qual double, components array<string>"


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path):
    every = []
    for name, n in (("a", 900), ("b", 0), ("c", 1), ("d", 3000)):
        own = [f"{name}{i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
        every += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    got = {r.line: r.value for r in lines.numbered_lines(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(every))


def test_two_sam_files_are_their_concatenation(spark, tmp_path):
    line = lambda name, at: f"{name}\t0\tchr1\t{at}\t60\t5M\t*\t0\t0\tACGTA\t*\n"
    one, two = "@SQ\tSN:chr2\tLN:9\n@SQ\tSN:chr1\tLN:90\n" + line("r1", 5) + line("r2", 1), "@SQ\tSN:chr1\tLN:90\n@SQ\tSN:chr3\tLN:7\n" + line("r3", 2)
    for d in ("parts", "whole"):
        (tmp_path / d).mkdir()
    (tmp_path / "parts/1.sam").write_text(one)
    (tmp_path / "parts/2.sam").write_text(two)
    (tmp_path / "whole/1.sam").write_text(one + two)
    both = [[sorted(map(tuple, df.collect())) for df in alignments.read_sam(spark, str(tmp_path / d))] for d in ("parts", "whole")]
    assert both[0] == both[1] and [(o, c) for o, c, _ in both[0][0]] == [(0, "chr2"), (1, "chr1"), (2, "chr3")]
    assert [r[:2] for r in both[0][1]] == [(2, "r1"), (3, "r2"), (6, "r3")]


def test_fasta_of_any_line_length(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    seqs = {f"c{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((0, 1, 59, 60, 61, 700, 2500))}
    text = "dropped\n"
    for i, (name, seq) in enumerate(seqs.items()):
        width = (60, 7, 10_000)[i % 3]
        text += f">{name} more words\n" + "".join(seq[k : k + width].lower() + (" \n", "\n\n", "\r\n")[i % 3] for k in range(0, len(seq), width))
    (tmp_path / "a.fa").write_text(text)
    monkeypatch.setattr(reference, "LINES", 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    chunks = reference.read_fasta(spark, str(tmp_path / "a.fa"), 100, 20)
    got = sorted((r.chrom, r.chunk_start, r.seq) for r in chunks.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((n, k, s[k : k + 120]) for n, s in seqs.items() for k in range(0, len(s), 100))
    regions = [(i, rng.choice([*seqs, "none"]), a := rng.randint(-5, 2600), a + rng.choice([0, 1, 99, 100, 101, 900])) for i in range(200)] + [(900, "c5", None, 5), (901, None, 1, 5)]
    table = spark.createDataFrame(regions, "region_id int, chrom string, start long, stop long")
    want = {i: seqs.get(c, "")[max(a, 0) : max(b, 0)] if a is not None and c else "" for i, c, a, b in regions}
    assert {r.region_id: r.seq for r in reference.fetch(table, tables.stored(chunks, "chunks"), 100).collect()} == want
    (tmp_path / "one.fa").write_text(">long\n" + "ACGT" * 500_000)  # a sequence on one line
    long = reference.read_fasta(spark, str(tmp_path / "one.fa"))
    assert long.count() == 200 and long.where("length(seq) = 10200").count() == 199


def test_ordered_file_of_many_parts(spark, tmp_path):
    rows = spark.range(5000).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).orderBy(F.rand(1)).repartition(7)
    lines.write_ordered(rows, "id", str(tmp_path / "out.txt"), ["first"])
    assert (tmp_path / "out.txt").read_text().splitlines() == ["first", *(f"line {i}" for i in range(5000))]
    assert [x.name for x in tmp_path.iterdir() if "parts" in x.name] == []
    lines.write_ordered(rows.limit(0), "id", str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text() == ""


def test_vcf_header_names_every_field(spark):
    contigs = spark.createDataFrame([(1, "chr2", 9), (0, "chr10", 5)], "ord int, chrom string, length long")
    head = variants.header(contigs)
    assert head[0].startswith("##fileformat=") and head[-1].split("\t")[:9] == "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()
    assert [x for x in head if x.startswith("##contig")] == ["##contig=<ID=chr10,length=5>", "##contig=<ID=chr2,length=9>"]
    assert all(re.fullmatch(r'##(INFO|FORMAT)=<ID=\w+,Number=[0-9AGR.],Type=(Integer|Float|Flag|Character|String),Description="[^"]+">', x) for x in head if x.startswith(("##INFO", "##FORMAT")))
    call = spark.createDataFrame([("DUP", "c", 5, 9, 4, 9.5, 0.5, 1.0, 2.0, 30, True, "DUP:TANDEM", None, None, None, ["x"], True, "tandem", 3, 1, 20.0, "PASS", "0/1", 5, 2, 3)], "sv_type string, chrom string, start long, stop long, size long, support double, af double, std_pos double, std_len double, mapq int, precise boolean, complex_type string, mate_chr string, mate_pos long, bnd_type string, components array<string>, in_repeat boolean, repeat_type string, forward long, reverse long, qual double, filter string, genotype string, genotype_qual int, ref_support long, alt_support long")
    line = variants.rendered(call).first().value.split("\t")
    assert {x.split("=")[0] for x in line[7].split(";")} <= set(variants.INFOS) and set(line[8].split(":")) == set(variants.FORMATS) and line[4][1:-1] in variants.ALTS


def test_info_maps(spark):
    rows = ["A=1;B;C=x=y", "A=1;A=2;B;A", "", None, ";;A=;", "A=1;B=2;A=3"]
    got = [dict(r[0]) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, info string").orderBy("i").select(variant_fields.info_map(F.col("info"))).collect()]
    assert got == [{"A": "1", "B": None, "C": "x=y"}, {"A": None, "B": None}, {}, {}, {"A": ""}, {"A": "3", "B": "2"}]


def test_found_files_and_csv(spark, tmp_path):
    for name in ("truth.vcf", "mine_calls.vcf", "old_calls.vcf", "other.vcf", "x.txt"):
        (tmp_path / name).write_text("#\n")
    name = lambda rows: sorted((r.caller, r.path.rsplit("/", 1)[1]) for r in rows.collect())
    assert name(variants.find_vcfs(spark, str(tmp_path))) == [("mine", "mine_calls.vcf"), ("old", "old_calls.vcf"), ("truth", "truth.vcf")]
    assert name(variants.find_vcfs(spark, str(tmp_path), {"a": ["no.vcf", "other.vcf", "old_calls.vcf"], "b": ["no.vcf"]})) == [("a", "other.vcf")]
    summary = spark.createDataFrame([("a", 0.79012, 0.5, 0.61, 3, 4, 5)], "caller string, precision double, recall double, f1 double, tp long, fp long, fn long")
    for _ in range(2):
        metrics.write_summaries(summary, str(tmp_path / "summary"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "summary"), header=True).collect()] == [("a", "0.790", "0.500", "0.610", "3", "4", "5")] * 2
    assert sorted(map(tuple, reports.summary_outcomes(summary).collect())) == [("a", "FN", 5), ("a", "FP", 4), ("a", "TP", 3)]
    metrics.write_runtimes(spark.createDataFrame([("run a", 12, 0.5)], "stage string, seconds int, memory_gb double"), str(tmp_path / "times"))
    assert [tuple(r) for r in metrics.read_runtimes(spark, str(tmp_path / "times"), {"run a": "a"}).collect()] == [("a", 12, 0.5)]


def test_reports(spark):
    rows = [("x", "DEL", 60, "PASS", True, None, 9.0, None), ("x", "DEL", 60, "MinAF;LowQual", False, None, 1.0, None), ("x", "CPX", 9, "LowQual", False, None, 1.0, ["DEL", "INS", "DEL"]), ("y", "DEL", 9, "PASS", None, None, None, ["INV"])]
    calls = spark.createDataFrame(rows, CALL)
    assert [tuple(r) for r in reports.reason_shares(calls).collect()] == [(1, "LowQual", 2, 50.0), (2, "MinAF", 1, 25.0)]
    assert [tuple(r) for r in reports.component_counts(calls).collect()] == [("DEL", 2), ("INS", 1)]
    assert {r.sv_type: (r.n, r.passed, r.mean_qual) for r in reports.type_quality(calls).collect()} == {"DEL": (3, 2, 5.0), "CPX": (1, 0, 1.0)}
    assert [tuple(r)[1:] for r in reports.detection(calls.where("sv_type = 'CPX'"), calls).collect()][::5] == [("DEL", 0, 2, None), ("CPX", 1, 0, 0.0)]
    assert reports.detection(calls.limit(0), calls.limit(0)).count() == 6 and reports.reason_shares(calls.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["log", "linear", "count"])
def test_size_distributions(spark, kind):
    rng = random.Random(3)
    sizes = [[rng.randint(1, 50) if kind == "linear" else 7 if kind == "count" else int(10 ** rng.uniform(1, 5)) for _ in range(n)] for n in (300, 201)]
    frame = lambda xs: spark.createDataFrame([("x", "DUP", s, "PASS", False, "TANDEM", 1.0, None) for s in xs] + [("x", "BND", 0, "PASS", False, None, 1.0, None)], CALL)
    got = reports.size_distributions(frame(sizes[0]), frame([*sizes[1], 0])).collect()
    assert {(r.side, r.n) for r in got if r.panel == "BND"} == {("truth", 1), ("detected", 1)}
    rows = [r for r in got if r.panel == "DUP_TANDEM"]
    assert {r.scale for r in rows} == {kind}
    if kind == "count":
        assert {(r.side, r.n, r.density) for r in rows} == {("truth", 300, None), ("detected", 201, None)}
        return
    every = sizes[0] + sizes[1]
    edges = np.geomspace(max(50, min(every)), max(every), 25) if kind == "log" else np.linspace(min(every), max(every), 25)
    edges[0], edges[-1] = max(50, min(every)) if kind == "log" else min(every), max(every)
    for side, xs in zip(("truth", "detected"), sizes, strict=True):
        counts, _ = np.histogram(xs, edges)
        density, _ = np.histogram(xs, edges, density=True)
        own = {r.bin: r for r in rows if r.side == side}
        assert [own[k].n if k in own else 0 for k in range(24)] == counts.tolist()
        assert all(own[k].density == pytest.approx(density[k]) and own[k].low == pytest.approx(edges[k]) for k in own)
    medians = {r.side: r.median for r in reports.size_medians(frame(sizes[0]), frame(sizes[1])).collect()}
    assert medians == {"truth": statistics.median_low(sizes[0]), "detected": statistics.median_low(sizes[1])}
