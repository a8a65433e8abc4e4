"""The relational test tables in the roles of the engine's tables. The same column expressions serve Spark and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORD = "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey"
TYPE = "case l_linenumber % 6 when 0 then 'BND' when 1 then 'DEL' when 2 then 'INS' when 3 then 'DUP' when 4 then 'INV' else 'CPX' end"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "aln": (
        "lineitem",
        {
            "ord": ORD,
            "read_name": "cast(l_orderkey as string)",
            "flag": "case when l_linenumber > 1 then 2048 else 0 end + case when l_returnflag = 'A' then 16 else 0 end + case when l_quantity > 48 then 4 else 0 end + case when l_quantity < 3 then 256 else 0 end",
            "chrom": "'chr' || cast(l_suppkey % 5 as string)",
            "start": "l_partkey * 100",
            "stop": "l_partkey * 100 + cast(floor(l_quantity) as bigint) * 10",
            "mapq": "cast(floor(l_quantity) as int)",
            "cigar": "cast(l_linenumber * 10 as string) || 'S' || cast(l_partkey % 100 + 20 as string) || 'M' || cast(cast(floor(l_quantity) as bigint) as string) || 'D30M' || cast(l_suppkey % 100 + 1 as string) || 'I5N40='",
            "sa": "case when l_returnflag = 'N' then null else 'chr' || cast(l_suppkey % 3 as string) || ',' || cast(l_partkey * 90 + 1 as string) || ',' || case when l_linestatus = 'F' then '+' else '-' end || ',50M,' || cast(cast(floor(l_quantity) as bigint) as string) || ',0;chr' || cast(l_partkey % 5 as string) || ',77,+,9M;' || 'chr' || cast(l_suppkey % 5 as string) || ',' || cast(l_partkey * 100 + 60000 as string) || ',+,50M,60,0;' end",
            "query_length": "cast(100 as int)",
        },
    ),
    "ev": (
        "lineitem",
        {
            "ord": ORD,
            "step": "cast(1 as int)",
            "sv_type": TYPE,
            "ev_type": "case l_linenumber % 6 when 0 then case l_returnflag when 'A' then 'SA_BND' when 'N' then 'SEGMENT_BND' else 'DISTANT_BND' end when 3 then case l_returnflag when 'A' then 'SA_DUP' when 'N' then 'INTER_DUP' else 'DEPTH_TANDEM' end when 1 then 'CIGAR_DEL' when 2 then 'CIGAR_INS' when 4 then 'SA_INV' else 'COMPLEX_WINDOW' end",
            "chrom": "'chr' || cast(l_suppkey % 5 as string)",
            "start": "l_partkey * 100",
            "stop": "l_partkey * 100 + cast(floor(l_quantity) as bigint) * 10",
            "size": "cast(floor(l_extendedprice / 2000) as bigint)",
            "read_name": "case when l_linenumber % 6 = 3 and l_returnflag = 'R' then 'depth_' else '' end || cast(l_orderkey as string)",
            "mapq": "cast(floor(l_quantity) as int)",
            "interspersed": "l_quantity > 45",
            "chr2": "case when l_linenumber % 6 = 0 then 'chr' || cast(l_partkey % 5 as string) end",
            "pos2": "case when l_linenumber % 6 = 0 then l_suppkey * 100 end",
            "bnd_type": "case when l_linenumber % 6 = 0 and l_returnflag = 'A' then 'N]' end",
        },
    ),
    "cand": (
        "orders",
        {
            "call_id": "o_orderkey",
            "sv_type": "case substr(o_orderpriority, 1, 1) when '1' then 'DEL' when '2' then 'INS' when '3' then 'DUP' when '4' then 'INV' else 'BND' end",
            "chrom": "'chr' || cast(o_custkey % 5 as string)",
            "start": "o_orderkey * 13",
            "stop": "o_orderkey * 13 + cast(floor(o_totalprice / 1000) as bigint)",
            "size": "cast(floor(o_totalprice / 1000) as bigint)",
            "support": "cast(o_custkey % 40 as double)",
            "af": "cast(o_orderkey % 100 as double) / 100",
            "std_pos": "cast(o_custkey % 30 as double)",
            "std_len": "cast(o_custkey % 20 as double)",
            "split_support": "cast(o_custkey % 4 as bigint)",
            "depth_support": "cast(o_orderkey % 4 as bigint)",
            "source": "case when o_orderkey % 3 = 0 then 'depth' else 'split_read' end",
            "genotype": "case o_orderkey % 4 when 0 then '0/1' when 1 then '1/1' when 2 then '0/0' else './.' end",
            "forward": "cast(o_custkey % 7 as bigint)",
            "reverse": "cast(o_orderkey % 5 as bigint)",
            "in_repeat": "o_custkey % 3 = 0",
            "repeat_type": "case when o_custkey % 3 = 0 then case when o_custkey % 2 = 0 then 'homopolymer' else 'tandem' end end",
            "filter": "case o_orderstatus when 'F' then 'PASS' when 'O' then 'LowQual' else 'MinAF;LowQual' end",
            "caller": "o_orderkey % 4",
            "dup_subtype": "case when o_custkey % 2 = 0 then 'INTERSPERSED' else 'TANDEM' end",
            "mapq": "cast(o_custkey % 60 as int)",
        },
    ),
    "rep": (
        "part",
        {"chrom": "'chr' || cast(p_partkey % 5 as string)", "start": "p_partkey * 100", "stop": "p_partkey * 100 + p_size * 10", "info": "p_type"},
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in cols.items()))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As long as the alignments and calls on them reach, so that every row lies on its contig at every scale."""
    ends = view(spark, sf_dir, "aln").select("chrom", "stop").unionAll(view(spark, sf_dir, "cand").select("chrom", "stop"))
    return ends.groupBy("chrom").agg(F.max("stop").alias("length")).select(F.substring("chrom", 4, 9).cast("int").alias("ord"), "chrom", "length")


_ENDS = " UNION ALL ".join(f"SELECT {cols['chrom']} AS chrom, {cols['stop']} AS stop FROM {source}" for source, cols in (VIEWS["aln"], VIEWS["cand"]))
CONTIGS_SQL = f"contigs AS (SELECT cast(substr(chrom, 4) AS int) AS ord, chrom, max(stop) AS length FROM ({_ENDS}) e GROUP BY chrom)"


def sql(*names: str) -> str:
    """WITH clause of the views for the checking SQL."""
    parts = [CONTIGS_SQL if n == "contigs" else f"{n} AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names]
    return "WITH RECURSIVE " + ", ".join(parts)
