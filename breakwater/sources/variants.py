"""VCF text: reading, repairing, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variant_fields as fields
from ..operators import sequences
from .lines import write_ordered

FIELDS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"
# Fixed values of the format: what ALT, INFO, FILTER and FORMAT fields are called, and their numbers and types.
ALTS = {"DEL": "Deletion", "INS": "Insertion", "DUP": "Duplication", "DUP:TANDEM": "Duplication beside its source", "DUP:INTERSPERSED": "Duplication elsewhere", "INV": "Inversion", "BND": "Breakend", "CPX": "Event of several breakpoints"}
INFOS = {
    "SVTYPE": ("1", "String", "Type of the variant"), "END": ("1", "Integer", "Last position"), "SVLEN": ("1", "Integer", "Length, below zero for deletions"), "SUPPORT": ("1", "Float", "Weighted support by reads"),
    "AF": ("A", "Float", "Share of reads"), "STDEV_POS": ("1", "Float", "Deviation of positions"), "STDEV_LEN": ("1", "Float", "Deviation of lengths"), "PRECISE": ("0", "Flag", "Seen within alignments"),
    "IMPRECISE": ("0", "Flag", "Not seen within alignments"), "MAPQ": ("1", "Integer", "Mean mapping quality"), "DUPTYPE": ("1", "String", "Kind of duplication"), "CN": ("1", "Float", "Copies"),
    "CHR2": ("1", "String", "Chromosome of the mate"), "POS2": ("1", "Integer", "Position of the mate"), "CPX_TYPE": (".", "String", "Types of a complex event"), "REPEAT": ("1", "String", "Repeat it lies in"), "STRAND_RATIO": ("1", "Float", "Share of the rarer strand"),
}
FILTERS = {
    "PASS": "Passed all filters", "MinSize": "Too short", "MinSupport": "Too little support", "MinAF": "Too small a share of reads", "LowMAPQ": "Low mapping quality", "LowQual": "Low quality", "LowGQ": "Low genotype quality",
    "HighSTDPos": "Positions differ too much", "StrandBias": "Nearly all reads on one strand", "Artifact": "Likely an artifact", "ImpreciseBreakpoint": "Imprecise breakpoint",
}
FORMATS = {"GT": ("1", "String", "Genotype"), "GQ": ("1", "Integer", "Genotype quality"), "DR": ("1", "Integer", "Reads of the reference"), "DV": ("1", "Integer", "Reads of the variant")}
COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The ten fields as text; rows with fewer than eight are dropped, missing ones are null."""
    return split(spark.read.text(path))


def split(lines: DataFrame) -> DataFrame:
    rows = lines.where(~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 8)
    return rows.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)))


def parsed(records: DataFrame) -> DataFrame:
    """Typed fields of VCF rows, 0-based. A field that is no number is null and never ends the file."""
    rows = records.withColumn("m", F.explode(F.array(fields.info_map(F.col("info")))))  # parsed once: an expression would be repeated for every key
    of = lambda key: F.try_element_at("m", F.lit(key))
    pos = F.col("pos").try_cast("bigint") - 1
    kind = F.coalesce(of("SVTYPE"), F.regexp_extract("alt", "^<([A-Z]+)", 1))
    stop = F.coalesce(of("END").try_cast("bigint"), pos + 2) - 1
    size = F.coalesce(F.abs(of("SVLEN").try_cast("bigint")), stop - pos)
    dup = F.when(F.startswith(kind, F.lit("DUP")), fields.dup_subtype(F.col("alt"), of("DUPTYPE"), F.col("info")))
    parts = F.when(of("CPX_TYPE").isNotNull(), F.split(of("CPX_TYPE"), ","))
    gt = fields.genotype(F.col("format"), F.col("sample"))
    return rows.select(
        "chrom", pos.alias("pos"), stop.alias("stop"), "id", F.when(F.startswith(kind, F.lit("DUP")), "DUP").otherwise(kind).alias("type"), "alt", size.alias("size"),
        F.coalesce(of("SUPPORT").try_cast("double"), F.lit(0.0)).alias("support"), F.coalesce(of("AF").try_cast("double"), F.lit(0.0)).alias("af"), "filter", F.coalesce(F.col("qual").try_cast("double"), F.lit(0.0)).alias("qual"),
        fields.repeat_flag(of("REPEAT")).alias("in_repeat"), fields.repeat_label(of("REPEAT")).alias("repeat_type"), parts.alias("components"), dup.alias("dup_subtype"), gt.alias("genotype"), fields.genotype_class(gt).alias("gt_class"),
        F.concat_ws(":", "chrom", fields.bucket(pos, 1000).cast("string"), kind).alias("key"),
    )


def repaired(lines: DataFrame) -> DataFrame:
    """Lines (value) with FILTER set from QUAL (over 5 passes), a missing SVTYPE put in from ALT, and at most ten fields; short rows dropped."""
    f, alt = F.col("f"), F.col("f")[4]
    score = F.when(f[5] == ".", F.lit(0.0)).otherwise(f[5].try_cast("double"))
    passed = F.when(score > 5, "PASS").otherwise("LowQual")
    ladder = F.lit("BND")
    for kind in ("INV", "DUP", "INS", "DEL"):
        ladder = F.when(F.contains(alt, F.lit(f"<{kind}")), kind).otherwise(ladder)
    info = F.when(F.contains(f[7], F.lit("SVTYPE=")), f[7]).otherwise(F.concat(F.lit("SVTYPE="), ladder, F.lit(";"), f[7]))
    head = F.startswith("value", F.lit("#"))
    rows = lines.withColumn("f", F.split("value", "\t")).where(head | (F.size("f") >= 8))
    line = F.concat_ws("\t", F.slice("f", 1, 6), passed, info, F.slice("f", 9, 2))
    return rows.select(F.when(head, F.col("value")).otherwise(line).alias("value"))


def _alt() -> Column:
    mate = F.concat("mate_chr", F.lit(":"), F.greatest(F.lit(1), F.col("mate_pos") + 1).cast("string"))
    bnd = F.when(F.col("bnd_type") == "N[", F.concat(F.lit("N["), mate, F.lit("["))).when(F.col("bnd_type") == "N]", F.concat(F.lit("N]"), mate, F.lit("]")))
    bnd = bnd.when(F.col("bnd_type") == "[N", F.concat(F.lit("["), mate, F.lit("[N"))).otherwise(F.concat(F.lit("]"), mate, F.lit("]N")))
    kind = F.col("sv_type")
    plain = F.concat(F.lit("<"), F.when((kind == "DUP") & F.col("complex_type").isNotNull(), F.col("complex_type")).otherwise(kind), F.lit(">"))
    return F.when(kind == "BND", F.coalesce(bnd, F.lit("<BND>"))).otherwise(plain)


def rendered(calls: DataFrame) -> DataFrame:
    """number, value: the VCF line of each call and its place in the order (chrom, start). Numbers are formatted half up."""
    rows = sequences.numbered(calls, "chrom", "start", ["stop", "sv_type", "size"])
    kind, pos = F.col("sv_type"), F.col("start") + 1
    end = F.when(kind == "BND", pos).when(F.col("stop") > F.col("start"), F.col("stop") + 1).otherwise(pos + F.greatest("size", F.lit(1)))
    pair = lambda key, value: F.concat(F.lit(key + "="), value.cast("string"))
    total = F.col("forward") + F.col("reverse")
    support = F.when(F.col("support") == F.floor("support"), F.col("support").cast("bigint").cast("string")).otherwise(F.col("support").cast("string"))
    info = F.concat_ws(
        ";", pair("SVTYPE", kind), pair("END", end), pair("SVLEN", F.when(kind == "DEL", -F.col("size")).otherwise(F.col("size"))), F.concat(F.lit("SUPPORT="), support),
        F.format_string("AF=%.3f", "af"), F.format_string("STDEV_POS=%.1f", "std_pos"), F.format_string("STDEV_LEN=%.1f", "std_len"), pair("MAPQ", F.col("mapq")),
        F.when(F.col("precise"), "PRECISE").otherwise("IMPRECISE"),
        F.when(kind == "DUP", F.concat(F.lit("DUPTYPE="), F.when(F.contains("complex_type", F.lit("INTERSPERSED")), "INTERSPERSED").otherwise("TANDEM"), F.lit(";CN=2.0"))),
        F.when(kind == "BND", F.concat(F.lit("CHR2="), "mate_chr", F.lit(";POS2="), F.greatest(F.lit(1), F.col("mate_pos") + 1).cast("string"))),
        F.when((kind == "CPX") & (F.size("components") > 0), F.concat(F.lit("CPX_TYPE="), F.array_join("components", ","))),
        F.when(F.col("in_repeat"), F.concat(F.lit("REPEAT="), "repeat_type")),
        F.when(total > 0, F.format_string("STRAND_RATIO=%.3f", F.least("forward", "reverse") / total)),
    )
    qual = F.when(F.col("qual") > 0, F.col("qual").cast("int")).otherwise(10)
    sample = F.concat_ws(":", "genotype", F.col("genotype_qual").cast("string"), F.col("ref_support").cast("string"), F.col("alt_support").cast("string"))
    line = F.concat_ws("\t", "chrom", pos.cast("string"), F.concat_ws("_", kind, F.col("number").cast("string")), F.lit("N"), _alt(), qual.cast("string"), "filter", info, F.lit("GT:GQ:DR:DV"), sample)
    return rows.select(F.col("number").cast("bigint").alias("number"), line.alias("value"))


def header(contigs: DataFrame | None = None) -> list[str]:
    """The header's lines: version, source, the contigs in order (a few thousand names at most, as in any VCF), and every field that lines can have."""
    known = contigs.orderBy("ord").select("chrom", "length").collect() if contigs is not None else []
    typed = lambda kind, table: [f'##{kind}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in table.items()]
    plain = lambda kind, table: [f'##{kind}=<ID={k},Description="{d}">' for k, d in table.items()]
    named = [f"##contig=<ID={r['chrom']},length={r['length']}>" for r in known]
    return ["##fileformat=VCFv4.3", "##source=breakwater", *named, *plain("ALT", ALTS), *typed("INFO", INFOS), *plain("FILTER", FILTERS), *typed("FORMAT", FORMATS), FIELDS]


def write_vcf(calls: DataFrame, path: str, contigs: DataFrame | None = None) -> None:
    """One VCF file: the header, then calls by (chrom, start)."""
    write_ordered(rendered(calls), "number", path, header(contigs))


def find_vcfs(spark: SparkSession, folder: str, names: dict[str, list[str]] | None = None, ending: str = "_calls.vcf") -> DataFrame:
    """caller, path of a folder's VCF files: of each caller the first of its names that is there. Without names, truth.vcf is the caller `truth` and
    files with the ending belong to the caller that they are called after. Contents aren't read; empty files don't count."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.vcf").load(folder).select("path", F.substring_index("path", "/", -1).alias("name"))
    if names is None:
        caller = F.when(F.col("name") == "truth.vcf", "truth").when(F.endswith("name", F.lit(ending)), F.expr(f"left(name, length(name) - {len(ending)})"))
        return found.select(caller.alias("caller"), "path").where("caller IS NOT NULL")
    wanted = spark.createDataFrame([(c, i, n) for c, files in names.items() for i, n in enumerate(files)], "caller string, rank int, name string")
    return found.join(F.broadcast(wanted), "name").groupBy("caller").agg(F.min_by("path", "rank").alias("path"))  # a few names
