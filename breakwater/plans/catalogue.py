"""The catalogue of registered queries over the test tables, with SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases, statistics
from ..operators import depth, intervals, sequences
from ..params import Params
from ..sources import reference, variants
from ..sources.tables import stored_path
from . import caller, calls, complexes, evaluation, evidence, genotyping, reports, scoring, whole_caller
from .adapters import contigs, sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P = Params()


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


USABLE = "use AS (SELECT *, (flag & 2048) = 0 AS prim, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand FROM aln WHERE (flag & 4) = 0 AND (flag & 256) = 0)"
DIST = "CASE sv_type WHEN 'BND' THEN 900 WHEN 'DEL' THEN 1000 WHEN 'DUP' THEN 250 WHEN 'INS' THEN 250 WHEN 'CPX' THEN 70 ELSE 200 END"


@query(sql("aln") + f", {USABLE} SELECT ord, read_name, chrom, start, prim AS \"primary\", strand FROM use")
def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.usable(view(spark, sf_dir, "aln")).select("ord", "read_name", "chrom", "start", "primary", "strand")


@query(
    sql("aln")
    + f""", {USABLE},
ops AS (SELECT ord, read_name, mapq, chrom, start, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS k
        FROM use WHERE prim AND mapq >= 30),
cut AS (SELECT *, cast(substr(o, 1, length(o) - 1) AS bigint) AS n, right(o, 1) AS op FROM ops),
loc AS (SELECT *, start + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY ord, read_name ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM cut)
SELECT CASE op WHEN 'I' THEN 'CIGAR_INS' ELSE 'CIGAR_DEL' END AS ev_type, chrom, cast(p AS bigint) AS start, cast(CASE op WHEN 'D' THEN p + n ELSE p END AS bigint) AS stop, n AS size, read_name, mapq
FROM loc WHERE (op = 'I' AND n >= 50) OR (op = 'D' AND n >= 15)"""
)
def cigar_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = evidence.usable(view(spark, sf_dir, "aln"))
    return evidence.from_cigar(reads, P).select("ev_type", "chrom", "start", "stop", "size", "read_name", "mapq")


SA = f""", {USABLE},
entries AS (SELECT ord, read_name, chrom, start, stop, mapq, strand, string_split(unnest(string_split(sa, ';')), ',') AS e FROM use WHERE sa IS NOT NULL),
good AS (SELECT *, e[1] AS c2, cast(e[2] AS bigint) - 1 AS loc, e[3] AS s2, cast(e[5] AS int) AS q2 FROM entries WHERE len(e) >= 6),
kinds AS (SELECT *, CASE WHEN c2 <> chrom THEN 'BND' WHEN s2 <> strand THEN CASE WHEN abs(loc - stop) >= 50 THEN 'INV' END WHEN abs(loc - stop) > 5000 THEN 'DUP' END AS k FROM good WHERE q2 >= 30),
sa_ev AS (SELECT ord, 'SA_' || k AS ev_type, k AS sv_type, chrom, CASE k WHEN 'BND' THEN stop ELSE least(start, loc) END AS start, CASE k WHEN 'BND' THEN stop ELSE greatest(stop, loc) END AS stop,
  CASE k WHEN 'BND' THEN 0 WHEN 'INV' THEN abs(loc - start) ELSE stop - start END AS size, read_name, least(mapq, q2) AS mapq,
  k = 'DUP' AND abs(loc - stop) > 50000 AS interspersed, CASE k WHEN 'BND' THEN c2 END AS chr2, CASE k WHEN 'BND' THEN loc END AS pos2 FROM kinds WHERE k IS NOT NULL)"""


@query(sql("aln") + SA + " SELECT ev_type, chrom, start, stop, cast(size AS bigint) AS size, read_name, mapq, interspersed, chr2, pos2 FROM sa_ev")
def supplementary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = evidence.usable(view(spark, sf_dir, "aln"))
    return evidence.from_supplementary(reads, P).select("ev_type", "chrom", "start", "stop", "size", "read_name", "mapq", "interspersed", "chr2", "pos2")


@query(
    sql("aln")
    + f""", {USABLE},
first AS (SELECT a.ord, a.read_name, a.chrom, a.start, a.stop, a.mapq, (SELECT min(b.ord) FROM use b WHERE b.read_name = a.read_name AND b.prim AND b.ord < a.ord) AS po FROM use a WHERE NOT a.prim)
SELECT f.chrom, least(f.start, p.start) AS start, greatest(f.stop, p.stop) AS stop, p.stop - p.start AS size, f.read_name, f.mapq
FROM first f JOIN use p ON p.ord = f.po AND p.read_name = f.read_name WHERE p.chrom = f.chrom AND abs(f.start - p.stop) > 50000"""
)
def far_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.from_far_copies(evidence.usable(view(spark, sf_dir, "aln"))).select("chrom", "start", "stop", "size", "read_name", "mapq")


SEGMENTS = f""", {USABLE},
seg AS (SELECT *, lead(chrom) OVER w AS c2, lead(start) OVER w AS s2, lead(strand) OVER w AS t2, lead(mapq) OVER w AS q2, lead(prim) OVER w AS p2 FROM use WINDOW w AS (PARTITION BY read_name ORDER BY start, ord)),
seg_ev AS (SELECT CASE WHEN c2 <> chrom THEN 'SEGMENT_BND' ELSE 'DISTANT_BND' END AS ev_type, 'BND' AS sv_type, chrom, stop AS start, stop, 0 AS size, read_name, least(mapq, q2) AS mapq, c2 AS chr2, s2 AS pos2,
  CASE WHEN c2 <> chrom THEN CASE WHEN strand = '+' AND t2 = '+' THEN 'N[' WHEN strand = '+' THEN 'N]' WHEN t2 = '+' THEN '[N' ELSE ']N' END END AS bnd_type, ord
  FROM seg WHERE c2 IS NOT NULL AND (prim OR p2) AND (c2 <> chrom OR abs(s2 - stop) > 100000))"""


@query(sql("aln") + SEGMENTS + " SELECT ev_type, chrom, start, read_name, mapq, chr2, pos2, bnd_type FROM seg_ev")
def adjacent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.from_segments(evidence.usable(view(spark, sf_dir, "aln"))).select("ev_type", "chrom", "start", "read_name", "mapq", "chr2", "pos2", "bnd_type")


@query(
    sql("aln")
    + SEGMENTS
    + """,
brk AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 900 THEN 0 ELSE 1 END AS b FROM seg_ev WINDOW w AS (PARTITION BY chrom ORDER BY start, ord)),
grp AS (SELECT *, sum(b) OVER (PARTITION BY chrom ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS g FROM brk)
SELECT chrom, cast(trunc(quantile_cont(start, 0.5)) AS bigint) AS start, count(DISTINCT read_name) AS n_reads, cast(greatest(count(DISTINCT read_name), count(*), CASE WHEN count(*) >= 2 THEN 2 * count(*) ELSE 0 END) AS double) AS support,
  count(*) FILTER (ev_type = 'SEGMENT_BND') AS split_support FROM grp GROUP BY chrom, g"""
)
def bnd_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.from_segments(evidence.usable(view(spark, sf_dir, "aln")))
    return calls.summed(calls.clusters(found, P), P).select("chrom", "start", "n_reads", "support", "split_support")


DEPTHS = f""", {USABLE},
wins AS (SELECT chrom, length, k * 900 AS ws, least(k * 900 + 1500, length) AS we FROM contigs, range(0, 2223) t(k) WHERE k * 900 < least(length, 2000000)),
met AS (SELECT w.*, u.sa FROM wins w JOIN use u ON u.chrom = w.chrom AND u.start < w.ws + 1500 AND greatest(u.stop, u.start + 1) > w.ws WHERE u.prim AND u.mapq >= 30),
far AS (SELECT chrom, ws, we, CASE WHEN sa IS NULL THEN 0 ELSE len(list_filter(string_split(sa, ';'), lambda x: x <> '' AND contains(x, chrom) AND abs(try_cast(string_split(x, ',')[2] AS bigint) - ws) > 50000)) END AS f FROM met),
depths AS (SELECT chrom, ws AS start, we AS stop, count(*) AS depth, cast(sum(f) AS bigint) AS distant_mappings FROM far GROUP BY 1, 2, 3)"""


@query(sql("aln", "contigs") + DEPTHS + " SELECT * FROM depths")
def depth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.window_depth(evidence.usable(view(spark, sf_dir, "aln")), contigs(spark, sf_dir), P.min_mapq).withColumn("distant_mappings", F.col("distant_mappings").cast("bigint"))


@query(sql("aln", "contigs") + DEPTHS + " SELECT chrom, start, stop, depth, CASE WHEN distant_mappings >= 3 THEN 'DEPTH_INTERSPERSED' ELSE 'DEPTH_TANDEM' END AS ev_type FROM depths WHERE depth > 2.0 * 1500 / 1000 * (3.8 - 0.5)")
def depth_duplications(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = depth.window_depth(evidence.usable(view(spark, sf_dir, "aln")), contigs(spark, sf_dir), P.min_mapq)
    return depth.duplicated(found, 2.0, P.dup_depth_threshold).select("chrom", "start", "stop", "depth", "ev_type")


SAMPLED = """s AS (SELECT chrom, length, length // 20 AS step, k FROM contigs, range(0, 20) t(k) WHERE ord < 5 AND length >= 10000),
sampled AS (SELECT chrom, cast(k AS int) AS sample, k * step + 1000 AS start, least(k * step + 2000, length - 1000) AS stop FROM s WHERE k * step + 1000 < least(k * step + 2000, length - 1000))"""
# Every base of every alignment as a row: what the sweep line must add up to.
BASES = """num AS (SELECT *, row_number() OVER () AS rid FROM aln),
ops AS (SELECT rid, chrom, start, mapq, flag, query_length, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS k FROM num),
cut AS (SELECT *, cast(substr(o, 1, length(o) - 1) AS bigint) AS n, right(o, 1) AS op FROM ops),
loc AS (SELECT *, start + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM cut),
base AS (SELECT chrom, cast(unnest(range(p::bigint, (p + n)::bigint)) AS bigint) AS pos, op IN ('M', '=', 'X') AND mapq >= 8 AS counted FROM loc WHERE op IN ('M', '=', 'X', 'D', 'N') AND flag & 1796 = 0),
col AS (SELECT chrom, pos, count(*) AS reads, count(*) FILTER (counted) AS depth FROM base GROUP BY 1, 2)"""


@query(
    sql("contigs")
    + f""", {SAMPLED} SELECT * FROM sampled"""
)
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.sample_windows(contigs(spark, sf_dir))


@query(
    sql("aln")
    + f""", {BASES},
brk AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(reads) OVER w = reads AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS b FROM col WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
run AS (SELECT *, sum(b) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM brk)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS stop, any_value(reads) AS reads, any_value(depth) AS depth FROM run GROUP BY chrom, g"""
)
def pileup_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every base as runs of equal depth; the SQL counts base by base."""
    return depth.pileup(view(spark, sf_dir, "aln"), 8)


MEANS = f""", {SAMPLED}, {BASES},
means AS (SELECT s.chrom, s.sample, sum(least(depth, 500)) / count(*) AS mean FROM sampled s JOIN col c ON c.chrom = s.chrom AND c.pos >= s.start AND c.pos < s.stop GROUP BY 1, 2)"""
BY_COUNT = """span AS (SELECT rid, any_value(chrom) AS chrom, any_value(start) AS start, any_value(mapq) AS mapq, any_value(flag) AS flag, any_value(query_length) AS size, sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) AS n FROM cut GROUP BY 1),
bycount AS (SELECT sum(CASE WHEN s.size > 0 THEN s.size ELSE 100 END) / any_value(least(1000000, length // 2)) AS c FROM contigs g JOIN span s ON g.ord = 0 AND s.chrom = g.chrom
  AND s.start < length // 4 + least(1000000, length // 2) AND s.start + s.n > length // 4 WHERE flag & 2308 = 0 AND mapq >= 10)"""


@query(sql("aln", "contigs") + MEANS + " SELECT chrom, sample, round(mean, 9) AS mean FROM means")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = depth.mean_depths(view(spark, sf_dir, "aln"), depth.sample_windows(contigs(spark, sf_dir)))
    return found.withColumn("mean", F.round("mean", 9))


@query(sql("aln", "contigs") + f", {BASES}, {BY_COUNT} SELECT CASE WHEN c BETWEEN 1 AND 200 THEN round(c, 9) END AS coverage FROM bycount")
def read_count_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.read_count_coverage(view(spark, sf_dir, "aln"), contigs(spark, sf_dir)).select(F.round("coverage", 9).alias("coverage"))


@query(
    sql("aln", "contigs")
    + MEANS
    + f""", {BY_COUNT}, r AS (SELECT mean, row_number() OVER (ORDER BY mean) AS i, count(*) OVER () AS n FROM means WHERE mean BETWEEN 0.5 AND 500),
m AS (SELECT quantile_cont(mean, 0.5) AS c FROM r WHERE n >= 5 AND i > n // 5 AND i <= n - n // 5)
SELECT round(coalesce(m.c, CASE WHEN b.c BETWEEN 1 AND 200 THEN b.c END, 30.0), 9) AS coverage FROM m, bycount b"""
)
def estimated_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.coverage(view(spark, sf_dir, "aln"), contigs(spark, sf_dir), P.coverage).select(F.round("coverage", 9).alias("coverage"))


@query(
    sql("cand")
    + """, r AS (SELECT size, row_number() OVER (ORDER BY size) AS i, count(*) OVER () AS n FROM cand)
SELECT quantile_cont(size, 0.5) AS coverage FROM r WHERE i > n // 5 AND i <= n - n // 5"""
)
def trimmed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.trimmed_median(view(spark, sf_dir, "cand").select("size"), "size")


CLUSTERED = f""",
brk AS (SELECT *, CASE WHEN start - lag(start) OVER w <= {DIST} AND (sv_type IN ('BND', 'CPX') OR abs(size - lag(size) OVER w) / greatest(size, lag(size) OVER w, 1) < 0.5) THEN 0 ELSE 1 END AS b
        FROM ev WINDOW w AS (PARTITION BY sv_type, chrom ORDER BY start, step, ord, size, read_name)),
clu AS (SELECT *, cast(sum(b) OVER (PARTITION BY sv_type, chrom ORDER BY start, step, ord, size, read_name ROWS UNBOUNDED PRECEDING) AS bigint) AS cluster FROM brk)"""


@query(sql("ev") + CLUSTERED + " SELECT sv_type, chrom, start, size, read_name, cluster FROM clu")
def chain_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.clusters(view(spark, sf_dir, "ev"), P).select("sv_type", "chrom", "start", "size", "read_name", "cluster")


@query(
    """WITH e AS (SELECT event_type, user_id, event_id, epoch_us(ts) // 1000000 AS sec FROM events),
b AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY event_type ORDER BY sec, event_id) <= 3600 THEN 0 ELSE 1 END AS n FROM e)
SELECT event_type, event_id, cast(sum(n) OVER (PARTITION BY event_type ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS "session" FROM b"""
)
def chain_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return sequences.chain(rows, ["event_type"], "at", ["event_id"], [], lambda before: F.col("at") - before["at"] > 3600, "session").select("event_type", "event_id", "session")


@query(
    sql("ev")
    + CLUSTERED
    + """,
agg AS (SELECT sv_type, chrom, cluster, count(*) AS n, count(DISTINCT CASE WHEN read_name NOT LIKE 'depth\\_%' ESCAPE '\\' THEN read_name END) AS nr, count(*) FILTER (contains(ev_type, 'DEPTH')) AS nd,
  count(*) FILTER (contains(ev_type, 'SA_')) AS ns, count(*) FILTER (ev_type IN ('SA_BND', 'SEGMENT_BND')) AS nj, cast(trunc(quantile_cont(start, 0.5)) AS bigint) AS ms, cast(trunc(quantile_cont(stop, 0.5)) AS bigint) AS me,
  cast(trunc(quantile_cont(size, 0.5)) AS bigint) AS mz, min(start) AS lo, max(stop) AS hi, cast(trunc(avg(mapq)) AS int) AS mapq, stddev_pop(start) AS sp, stddev_pop(size) AS sl, bool_or(contains(ev_type, 'CIGAR')) AS precise,
  bool_or(interspersed OR contains(ev_type, 'INTER')) AS far, arg_min(chr2, (start, step, ord)) FILTER (chr2 IS NOT NULL) AS c2, arg_min(pos2, (start, step, ord)) FILTER (chr2 IS NOT NULL) AS p2,
  arg_min(coalesce(bnd_type, 'N['), (start, step, ord)) FILTER (chr2 IS NOT NULL) AS bt FROM clu GROUP BY 1, 2, 3),
sup AS (SELECT *, cast(CASE sv_type WHEN 'DUP' THEN CASE WHEN nd > 0 THEN greatest(nr + 5 * nd, 3.5 * nd + ns) ELSE nr END WHEN 'BND' THEN greatest(nr, n, CASE WHEN n >= 2 THEN 2 * n ELSE 0 END) ELSE nr + 5 * nd END AS double) AS support FROM agg),
kept AS (SELECT * FROM sup WHERE n >= CASE sv_type WHEN 'DUP' THEN 3 WHEN 'CPX' THEN 7 ELSE 1 END AND (sv_type = 'CPX' OR support >= CASE sv_type WHEN 'BND' THEN 1 WHEN 'DUP' THEN CASE WHEN nd > 0 THEN 1 ELSE 2 END ELSE 2 END))
SELECT sv_type, chrom, cluster, CASE sv_type WHEN 'CPX' THEN lo ELSE ms END AS start, CASE sv_type WHEN 'CPX' THEN hi WHEN 'BND' THEN ms ELSE CASE WHEN me > ms THEN me ELSE ms + greatest(mz, 1) END END AS stop,
  CASE sv_type WHEN 'CPX' THEN hi - lo ELSE mz END AS size, support, mapq, CASE WHEN nd > 0 THEN 'depth' ELSE 'split_read' END AS source,
  round(CASE WHEN sv_type = 'DUP' AND nd > 0 THEN greatest(support / 30, 15e-2) ELSE support / 30 END, 6) AS af, round(sp, 6) AS std_pos, round(CASE sv_type WHEN 'BND' THEN 0e0 ELSE sl END, 6) AS std_len, precise,
  CASE sv_type WHEN 'BND' THEN coalesce(c2, chrom) END AS mate_chr, CASE sv_type WHEN 'BND' THEN coalesce(p2, ms) END AS mate_pos, CASE sv_type WHEN 'BND' THEN coalesce(bt, 'N[') END AS bnd_type,
  CASE sv_type WHEN 'BND' THEN nj ELSE ns END AS split_support, nr - ns AS spanning_support, nd AS depth_support, CASE sv_type WHEN 'DUP' THEN CASE WHEN far THEN 'DUP:INTERSPERSED' ELSE 'DUP:TANDEM' END END AS complex_type FROM kept"""
)
def create_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ev").withColumn("components", F.expr("cast(null as array<string>)"))
    found = calls.summed(calls.clusters(rows, P), P).drop("n_reads", "components", "is_complex")
    return found.withColumns({c: F.round(c, 6) for c in ("af", "std_pos", "std_len")})


ANCHORS = """, pts AS (SELECT DISTINCT chrom, start FROM ev), walk AS (
  SELECT chrom, min(start) AS a FROM pts GROUP BY chrom UNION ALL
  SELECT w.chrom, (SELECT min(p.start) FROM pts p WHERE p.chrom = w.chrom AND p.start > w.a + 1000) FROM walk w WHERE w.a IS NOT NULL),
win AS (SELECT e.*, (SELECT max(w.a) FROM walk w WHERE w.chrom = e.chrom AND w.a <= e.start) AS anchor FROM ev e)"""


@query(sql("ev") + ANCHORS + " SELECT chrom, start, read_name, size, anchor FROM win")
def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.anchored(view(spark, sf_dir, "ev"), "chrom", "start", 1000).select("chrom", "start", "read_name", "size", "anchor")


@query(
    sql("ev")
    + ", src AS (SELECT * REPLACE ('r' || (start // 3000) AS read_name) FROM ev)"
    + ANCHORS.replace("FROM ev", "FROM src")
    + " SELECT chrom, min(start) AS start, max(stop) AS stop, min(read_name) AS read_name, count(*) AS n FROM win GROUP BY chrom, anchor HAVING count(*) >= 2 AND count(DISTINCT read_name) = 1"
)
def single_read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose reads are taken from its place, as in the test data no window has a single one."""
    rows = view(spark, sf_dir, "ev").withColumn("read_name", F.concat(F.lit("r"), F.floor(F.col("start") / 3000).cast("string")))
    found = complexes.single_read_windows(rows)
    return found.select("chrom", "start", "stop", "read_name", F.size("components").cast("bigint").alias("n"))


@query(
    sql("rep")
    + """, m AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM rep),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n, CASE WHEN min(info) = max(info) THEN min(info) ELSE 'repeat' END AS info FROM g GROUP BY chrom, k"""
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.merge(view(spark, sf_dir, "rep"), ["chrom"], pad=50, label="info")


@query(sql("cand", "rep") + " SELECT c.call_id, r.start AS r_start, r.info AS r_info FROM cand c JOIN rep r ON c.chrom = r.chrom AND c.start < r.stop AND greatest(c.stop, c.start + 1) > r.start")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(view(spark, sf_dir, "cand"), view(spark, sf_dir, "rep"), "chrom").select("call_id", "r_start", "r_info")


@query(sql("cand", "rep") + " SELECT c.call_id, EXISTS (SELECT 1 FROM rep r WHERE r.chrom = c.chrom AND c.start <= r.stop AND c.stop >= r.start) AS in_repeat FROM cand c")
def repeat_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "cand").withColumn("is_complex", F.lit(False)).drop("in_repeat", "repeat_type")
    return calls.with_repeats(rows, view(spark, sf_dir, "rep"), ids=("call_id",)).select("call_id", "in_repeat")


@query(
    sql("cand", "rep")
    + " SELECT c.call_id, EXISTS (SELECT 1 FROM rep r WHERE r.chrom = c.chrom AND r.start <= c.start AND c.start < r.stop) AS covered FROM cand c"
)
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "cand").select("call_id", "chrom", "start", (F.col("start") + 1).alias("stop"))
    return intervals.covered(points, view(spark, sf_dir, "rep"), "chrom", ["call_id"]).select("call_id", "covered")


@query(
    """SELECT doc_id, translate(array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), ''), 'ATCG', 'TAGC') AS reverse_complement, regexp_matches(text, 'e{2}|t{2}|s{2}') AS doubled,
  substr(text, 1, 2) = substr(text, 3, 2) AND length(text) >= 4 AND NOT contains(substr(text, 1, 4), chr(10)) AS two, substr(text, 1, 3) = substr(text, 4, 3) AND length(text) >= 6 AND NOT contains(substr(text, 1, 6), chr(10)) AS three FROM documents"""
)
def base_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return docs.select("doc_id", bases.reverse_complement(text).alias("reverse_complement"), bases.has_homopolymer(text, 2, "ets").alias("doubled"), text.rlike(r"^(..)\1").alias("two"), text.rlike(r"^(...)\1").alias("three"))


REGION = """, reg AS (SELECT c.call_id, c.chrom, least(greatest(0, c.start - 1000), g.length - 1) AS rs, least(g.length, CASE WHEN c.sv_type = 'BND' THEN c.start WHEN c.stop > c.start THEN c.stop ELSE c.start + greatest(c.size, 1) END + 1000) AS re
  FROM cand c JOIN contigs g ON g.chrom = c.chrom)"""


@query(
    sql("cand", "aln", "contigs")
    + f", {USABLE}"
    + REGION
    + """, own AS (SELECT call_id, cast(unnest([call_id % 50, call_id % 77]) AS string) AS read_name FROM cand),
dist AS (SELECT call_id, count(DISTINCT read_name) AS alt FROM own GROUP BY 1),
seen AS (SELECT DISTINCT r.call_id, u.read_name FROM reg r JOIN use u ON u.chrom = r.chrom AND u.start < r.re AND greatest(u.stop, u.start + 1) > r.rs WHERE r.rs < r.re AND u.prim AND u.mapq >= 30),
refs AS (SELECT s.call_id, count(*) AS n FROM seen s WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.call_id = s.call_id AND o.read_name = s.read_name) GROUP BY 1),
t AS (SELECT c.call_id, c.source, c.af AS old, CASE WHEN r.rs < r.re THEN d.alt ELSE 0 END AS alt, CASE WHEN r.rs < r.re THEN coalesce(refs.n, 0) ELSE 0 END AS ref FROM cand c JOIN dist d USING (call_id) LEFT JOIN reg r USING (call_id) LEFT JOIN refs USING (call_id))
SELECT call_id, alt AS alt_support, ref AS ref_support, CASE WHEN alt + ref = 0 THEN './.' WHEN alt / (alt + ref) < 0.08 THEN '0/0' WHEN alt / (alt + ref) < 0.55 THEN '0/1' ELSE '1/1' END AS genotype,
  CASE WHEN alt + ref = 0 THEN 0 ELSE cast(least(99, trunc(40 * (alt / (alt + ref)))) AS int) END AS genotype_qual, round(CASE WHEN alt + ref = 0 THEN old WHEN source = 'depth' THEN greatest(alt / (alt + ref), 0.25) ELSE alt / (alt + ref) END, 6) AS af FROM t"""
)
def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "cand")
    own = rows.select("call_id", F.explode(F.array_distinct(F.array((F.col("call_id") % 50).cast("string"), (F.col("call_id") % 77).cast("string")))).alias("read_name"))
    found = genotyping.genotype(rows, own, evidence.usable(view(spark, sf_dir, "aln")), contigs(spark, sf_dir), P)
    return found.select("call_id", "alt_support", "ref_support", "genotype", "genotype_qual", F.round("af", 6).alias("af"))


@query(
    sql("cand", "aln")
    + f", {USABLE}"
    + """, own AS (SELECT DISTINCT call_id, chrom, start - 1000 AS f, stop + 1000 AS t, cast(unnest([call_id % 50, call_id % 77, call_id // 4]) AS string) AS read_name FROM cand),
fst AS (SELECT o.call_id, o.read_name, arg_min(u.strand, u.ord) AS s FROM own o JOIN use u ON u.read_name = o.read_name AND u.chrom = o.chrom AND u.start < o.t AND u.stop > o.f GROUP BY 1, 2)
SELECT c.call_id, count(*) FILTER (s = '+') AS forward, count(*) FILTER (s = '-') AS reverse FROM cand c LEFT JOIN fst USING (call_id) GROUP BY 1"""
)
def strand_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("call_id")
    reads = F.array_distinct(F.array((key % 50).cast("string"), (key % 77).cast("string"), F.floor(key / 4).cast("bigint").cast("string")))
    rows = view(spark, sf_dir, "cand").drop("forward", "reverse")
    return genotyping.strands(rows, rows.select("call_id", F.explode(reads).alias("read_name")), evidence.usable(view(spark, sf_dir, "aln"))).select("call_id", "forward", "reverse")


QUAL = """, cdf AS (SELECT *, 15.0 * CASE genotype WHEN '1/1' THEN 2 ELSE 1 END AS mu FROM cand),
pois AS (SELECT *, list_sum(list_transform(range(0, cast(support AS bigint)), lambda i: exp(-mu + i * ln(mu) - lgamma(i + 1)))) AS below, list_sum(list_transform(range(0, cast(support AS bigint) + 1), lambda i: exp(-mu + i * ln(mu) - lgamma(i + 1)))) AS upto FROM cdf),
sq AS (SELECT *, CASE WHEN support = 0 THEN 0 WHEN support >= mu THEN least(60, -10 * log10(1 - least(1, coalesce(below, 0)) + 1e-10)) ELSE least(60, -10 * log10(least(1, upto) + 1e-10)) END AS q1,
  CASE WHEN forward + reverse = 0 THEN 0 WHEN least(forward, reverse) / (forward + reverse) < 0.1 THEN 10 ELSE 30 END AS q2,
  CASE WHEN std_pos = 0 THEN 40 WHEN std_pos / greatest(size, 1) < 0.1 THEN 35 WHEN std_pos / greatest(size, 1) < 0.3 THEN 25 WHEN std_pos / greatest(size, 1) < 0.5 THEN 15 ELSE 5 END AS q3,
  CASE WHEN af < 0.1 THEN 5 WHEN af < 0.2 THEN 15 WHEN af < 0.35 THEN 25 ELSE 30 END AS q4 FROM pois),
scored AS (SELECT *, least(99e0, (0.4 * q1 + 0.2 * q2 + 0.2 * q3 + 0.2 * q4) * CASE WHEN sv_type = 'BND' AND split_support > 0 THEN 1.2e0 WHEN sv_type = 'DUP' AND depth_support > 0 THEN 1.3e0 WHEN sv_type = 'INS' AND std_len < 10 THEN 1.1e0 ELSE 1e0 END
  * CASE repeat_type WHEN 'homopolymer' THEN 0.7e0 ELSE 1e0 END) AS qual FROM sq)"""


@query(sql("cand") + QUAL + " SELECT call_id, round(qual, 4) AS qual FROM scored")
def call_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_quality(view(spark, sf_dir, "cand"), P).select("call_id", F.round("qual", 4).alias("qual"))


@query(
    sql("cand")
    + QUAL
    + """, lim AS (SELECT *, CASE sv_type WHEN 'DUP' THEN CASE WHEN (in_repeat AND (source = 'depth' OR depth_support > 2)) OR (NOT in_repeat AND source = 'depth' AND depth_support >= 2) THEN 2 ELSE 3 END
    WHEN 'BND' THEN 1 WHEN 'DEL' THEN 1 WHEN 'INS' THEN CASE WHEN in_repeat THEN 1 ELSE 5 END ELSE CASE WHEN in_repeat THEN 6 ELSE 3 END END AS ms,
  CASE sv_type WHEN 'DUP' THEN 0.4e0 WHEN 'BND' THEN CASE WHEN in_repeat THEN 0.03e0 ELSE 0.03e0 * 0.8e0 END WHEN 'DEL' THEN CASE WHEN in_repeat THEN 0.015e0 * 1.1e0 ELSE 0.015e0 * 0.4e0 END WHEN 'INS' THEN 0.25e0 * 1.1e0 ELSE CASE WHEN in_repeat THEN 0.15e0 * 1.1e0 ELSE 0.15e0 END END AS ma FROM scored),
lab AS (SELECT *, support < ms AS a, af < ma AS b, qual < CASE WHEN sv_type IN ('BND', 'DEL') THEN 4 ELSE 10 END AS c FROM lim),
fin AS (SELECT call_id, CASE WHEN sv_type = 'DUP' AND qual >= 20 AND source = 'depth' AND depth_support >= 3 THEN '' ELSE concat_ws(';', CASE WHEN a AND NOT (sv_type = 'BND' AND support >= 1) THEN 'MinSupport' END, CASE WHEN b AND NOT (sv_type = 'DUP' AND qual >= 20) THEN 'MinAF' END, CASE WHEN c THEN 'LowQual' END) END AS f FROM lab)
SELECT call_id, CASE f WHEN '' THEN 'PASS' ELSE f END AS filter FROM fin"""
)
def call_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_filters(scoring.with_quality(view(spark, sf_dir, "cand"), P), P).select("call_id", "filter")


@query(
    sql("cand")
    + """, c AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, stop, sv_type) AS i FROM cand),
occ AS (SELECT chrom, i, 'r' || (call_id % 3 + unnest(range(0, 5))) AS read FROM c),
near AS (SELECT a.chrom, a.i, max(b.i) AS r FROM c a JOIN c b ON b.chrom = a.chrom AND b.i >= a.i AND b.start - a.stop <= 1000 GROUP BY 1, 2),
twice AS (SELECT n.chrom, n.i, n.r, o.read FROM near n JOIN occ o ON o.chrom = n.chrom AND o.i BETWEEN n.i AND n.r GROUP BY ALL HAVING count(*) >= 2),
good AS (SELECT chrom, i, r FROM twice WHERE r > i GROUP BY ALL HAVING count(*) >= 4),
walk AS (SELECT chrom, arg_min(r, i) AS r, min(i) AS i FROM good GROUP BY 1
  UNION ALL SELECT w.chrom, g.r, g.i FROM walk w JOIN good g ON g.chrom = w.chrom AND g.i = (SELECT min(x.i) FROM good x WHERE x.chrom = w.chrom AND x.i > w.r))
SELECT w.chrom, min(start) AS start, max(stop) AS stop, max(stop) - min(start) AS size, cast((SELECT count(DISTINCT read) FROM occ o WHERE o.chrom = w.chrom AND o.i BETWEEN w.i AND w.r) AS double) AS support, cast(trunc(avg(mapq)) AS int) AS mapq,
  (SELECT string_agg(DISTINCT read, ',' ORDER BY read) FROM occ o WHERE o.chrom = w.chrom AND o.i BETWEEN w.i AND w.r) AS reads, string_agg(sv_type, ',' ORDER BY c.i) AS components
FROM walk w JOIN c ON c.chrom = w.chrom AND c.i BETWEEN w.i AND w.r GROUP BY w.chrom, w.i, w.r"""
)
def shared_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring candidates that share reads."""
    rows = view(spark, sf_dir, "cand")
    own = rows.select("call_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("call_id", F.concat(F.lit("r"), (F.col("call_id") % 3 + F.col("i")).cast("string")).alias("read_name"))
    events, reads = complexes.shared_read_events(rows, own, Params(complex_reads=4))
    named = reads.groupBy("event").agg(F.array_join(F.array_sort(F.collect_list("read_name")), ",").alias("reads"))
    return events.join(named, "event").drop("event").withColumn("components", F.array_join("components", ","))


@query(sql("cand") + " SELECT call_id, row_number() OVER (ORDER BY chrom, start, call_id) AS number FROM cand")
def global_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.numbered(view(spark, sf_dir, "cand"), "chrom", "start", ["call_id"]).select("call_id", F.col("number").cast("bigint").alias("number"))


RENDERED = {"alt_support": "split_support", "ref_support": "depth_support", "complex_type": "case when sv_type = 'DUP' then 'DUP:' || dup_subtype end", "mate_chr": "case when sv_type = 'BND' then chrom end", "mate_pos": "case when sv_type = 'BND' then start - 5 end", "bnd_type": "case when sv_type = 'BND' then case call_id % 4 when 0 then 'N[' when 1 then 'N]' when 2 then '[N' else ']N' end end"}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "cand").selectExpr("*", *(f"{e} AS {c}" for c, e in RENDERED.items()), "call_id % 2 = 0 AS precise", "cast(array() as array<string>) AS components", "cast(support as int) AS genotype_qual", "support AS qual")
    return variants.rendered(rows)


@query(
    sql("cand")
    + """, n AS (SELECT *, row_number() OVER (ORDER BY chrom, start, stop, sv_type, size) AS i FROM cand)
SELECT chrom, start AS pos, CASE sv_type WHEN 'BND' THEN start WHEN 'INS' THEN CASE WHEN stop > start THEN stop ELSE start + greatest(size, 1) - 1 END ELSE CASE WHEN stop > start THEN stop ELSE start + greatest(size, 1) - 1 END END AS stop,
  sv_type || '_' || i AS id, sv_type AS type, size, support, filter, CASE WHEN support > 0 THEN cast(floor(support) AS double) ELSE 10e0 END AS qual, in_repeat, repeat_type, CASE sv_type WHEN 'DUP' THEN dup_subtype END AS dup_subtype, genotype,
  CASE genotype WHEN '0/1' THEN 'het' WHEN '1/1' THEN 'hom' WHEN '0/0' THEN 'ref' ELSE 'Unknown' END AS gt_class FROM n"""
)
def vcf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as VCF lines and parsed again."""
    return variants.parsed(variants.split(_lines(spark, sf_dir))).select("chrom", "pos", "stop", "id", "type", "size", "support", "filter", "qual", "in_repeat", "repeat_type", "dup_subtype", "genotype", "gt_class")


@query(sql("cand") + " SELECT call_id, CASE WHEN support > 5 THEN 'PASS' ELSE 'LowQual' END AS filter, 'SVTYPE=' || sv_type || ';END=' || stop AS info FROM cand")
def repaired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("call_id").cast("string"), F.lit("N"), F.concat(F.lit("<"), "sv_type", F.lit(">")), F.col("support").cast("string"), F.lit("x"), F.concat(F.lit("END="), F.col("stop").cast("string")), F.lit("GT"), F.lit("0/1"), F.lit("more"))
    fixed = variants.repaired(view(spark, sf_dir, "cand").select(line.alias("value"))).select(F.split("value", "\t").alias("f"))
    return fixed.select(F.col("f")[2].cast("bigint").alias("call_id"), F.col("f")[6].alias("filter"), F.col("f")[7].alias("info"))


@query(sql("cand") + " SELECT sv_type, count(*) AS n, count(*) FILTER (filter = 'PASS') AS passed FROM cand GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_counts(view(spark, sf_dir, "cand"))


@query(sql("cand") + " SELECT caller, count(*) AS n, count(*) FILTER (contains(filter, 'PASS')) AS passed, count(*) FILTER (contains(filter, 'PASS')) * 100 // count(*) AS percent FROM cand GROUP BY 1")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pass_rates(view(spark, sf_dir, "cand"))


@query(sql("cand") + ", r AS (SELECT unnest(string_split(filter, ';')) AS reason FROM cand) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.filter_reasons(view(spark, sf_dir, "cand"))


@query(sql("cand") + " SELECT caller, count(*) FILTER (dup_subtype = 'INTERSPERSED') AS interspersed, count(*) FILTER (dup_subtype <> 'INTERSPERSED') AS tandem FROM cand WHERE sv_type = 'DUP' AND filter = 'PASS' GROUP BY 1")
def dup_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dup_subtypes(view(spark, sf_dir, "cand"))


@query(sql("cand") + " SELECT caller, count(*) FILTER (filter = 'PASS' AND in_repeat) AS in_repeat, count(*) FILTER (filter = 'PASS' AND NOT in_repeat) AS outside FROM cand GROUP BY 1")
def repeat_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repeat_overview(view(spark, sf_dir, "cand"))


@query(sql("cand") + " SELECT CASE repeat_type WHEN 'homopolymer' THEN 'Homopolymer' ELSE 'Tandem Repeat' END AS label, count(*) AS n FROM cand WHERE filter = 'PASS' AND in_repeat GROUP BY 1")
def repeat_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repeat_types(view(spark, sf_dir, "cand"))


@query(
    sql("cand")
    + """ SELECT caller, count(*) FILTER (genotype = '0/1') AS het, count(*) FILTER (genotype = '1/1') AS hom, count(*) FILTER (genotype = '0/0') AS ref, count(*) FILTER (genotype = './.') AS unknown, count(*) AS n,
  count(*) FILTER (genotype = '0/1') / count(*) AS het_rate, count(*) FILTER (genotype = '1/1') / count(*) AS hom_rate FROM cand WHERE filter = 'PASS' GROUP BY 1"""
)
def genotype_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.genotype_classes(view(spark, sf_dir, "cand"))


@query(
    sql("cand")
    + """, b AS (SELECT sv_type, size, cast(least(23, greatest(0, floor((log10(size) - log10(10e0)) / ((log10(1e6) - log10(10e0)) / 24)))) AS bigint) AS bin FROM cand WHERE filter = 'PASS' AND size > 0)
, m AS (SELECT sv_type, quantile_cont(size, 0.5) AS median FROM b GROUP BY 1)
SELECT sv_type, bin, count(*) AS n, any_value(median) AS median FROM b JOIN m USING (sv_type) GROUP BY 1, 2"""
)
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_histogram(view(spark, sf_dir, "cand"))


REASONS = ", r AS (SELECT unnest(string_split(filter, ';')) AS reason FROM cand WHERE filter <> 'PASS'), n AS (SELECT reason, count(*) AS n FROM r GROUP BY 1)"


@query(sql("cand") + REASONS + " SELECT cast(row_number() OVER (ORDER BY n DESC, reason) AS int) AS place, reason, n, round(100 * n / (SELECT count(*) FROM cand), 9) AS percent FROM n")
def reason_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reason_shares(view(spark, sf_dir, "cand")).withColumn("percent", F.round("percent", 9))


@query(sql("cand") + " SELECT sv_type, count(*) AS n, count(*) FILTER (filter = 'PASS') AS passed, round(100 * count(*) FILTER (filter = 'PASS') / count(*), 9) AS percent, round(avg(support), 9) AS mean_qual FROM cand GROUP BY 1")
def type_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.type_quality(view(spark, sf_dir, "cand").withColumn("qual", F.col("support")))
    return found.withColumns({c: F.round(c, 9) for c in ("percent", "mean_qual")})


@query(sql("ev") + ", c AS (SELECT read_name FROM ev GROUP BY 1 HAVING count(*) > 2) SELECT sv_type AS component, count(*) AS n FROM ev SEMI JOIN c USING (read_name) GROUP BY 1")
def component_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with three rows of evidence or more as complex calls of their types."""
    rows = view(spark, sf_dir, "ev").groupBy("read_name").agg(F.collect_list("sv_type").alias("components")).where(F.size("components") > 2)
    return reports.component_counts(rows.withColumn("sv_type", F.lit("CPX")))


DETECTED = """, k(place, sv_type) AS (VALUES (0, 'DEL'), (1, 'INS'), (2, 'DUP'), (3, 'INV'), (4, 'BND'), (5, 'CPX')),
n AS (SELECT sv_type, count(*) FILTER (caller % 2 = 0) AS truth, count(*) FILTER (caller % 2 = 1 AND filter = 'PASS') AS detected FROM cand WHERE {} GROUP BY 1)
SELECT place, sv_type, coalesce(truth, 0) AS truth, coalesce(detected, 0) AS detected, round(CASE WHEN truth > 0 THEN 100 * detected / truth END, 9) AS rate FROM k LEFT JOIN n USING (sv_type)"""


def _truth_and_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "cand")
    return rows.where("caller % 2 = 0"), rows.where("caller % 2 = 1")


@query(sql("cand") + DETECTED.format("true"))
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detection(*_truth_and_calls(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query(sql("cand") + DETECTED.format("in_repeat"))
def detection_in_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detection(*_truth_and_calls(spark, sf_dir), F.col("in_repeat")).withColumn("rate", F.round("rate", 9))


SIDES = """, side AS (SELECT CASE sv_type WHEN 'DUP' THEN 'DUP_' || dup_subtype ELSE sv_type END AS panel, CASE WHEN caller % 2 = 0 THEN 'truth' ELSE 'detected' END AS side, size, cast(size AS DOUBLE) AS x
  FROM cand WHERE caller % 2 = 0 OR filter = 'PASS')"""


@query(
    sql("cand")
    + SIDES
    + """, e AS (SELECT panel, greatest(min(x), 50e0) AS lo, max(x) AS hi FROM side WHERE panel <> 'BND' AND x > 0 GROUP BY 1),
b AS (SELECT panel, side, lo, hi, cast(least(23, floor((log10(x) - log10(lo)) / (log10(hi) - log10(lo)) * 24)) AS int) AS bin, count(*) AS n FROM side JOIN e USING (panel) WHERE x BETWEEN lo AND hi GROUP BY ALL),
w AS (SELECT *, CASE bin WHEN 0 THEN lo ELSE pow(10, log10(lo) + bin / 24 * (log10(hi) - log10(lo))) END AS low, CASE bin WHEN 23 THEN hi ELSE pow(10, log10(lo) + (bin + 1) / 24 * (log10(hi) - log10(lo))) END AS high FROM b)
SELECT panel, 'log' AS scale, side, bin, round(low, 6) AS low, round(high, 6) AS high, n, round(n / (sum(n) OVER (PARTITION BY panel, side) * (high - low)), 9) AS density FROM w
UNION ALL SELECT panel, 'count', side, NULL, NULL, NULL, count(*), NULL FROM side WHERE panel = 'BND' GROUP BY ALL"""
)
def size_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.size_distributions(*_truth_and_calls(spark, sf_dir))
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6), "density": F.round("density", 9)})


@query(sql("cand") + SIDES + " SELECT panel, side, count(*) AS n, quantile_disc(size, 0.5) AS median FROM side WHERE panel <> 'BND' AND size > 0 GROUP BY ALL HAVING count(*) > 1")
def size_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_medians(*_truth_and_calls(spark, sf_dir))


@query(
    sql("cand")
    + """, s AS (SELECT caller % 2 AS caller, CASE WHEN filter = 'PASS' THEN 'TP' WHEN in_repeat THEN 'FP' ELSE 'FN' END AS state FROM cand), k(outcome) AS (VALUES ('TP'), ('FP'), ('FN'))
SELECT caller, outcome, count(*) FILTER (state = outcome) AS n FROM s, k GROUP BY ALL"""
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by caller, of states taken from the candidates' filters."""
    state = F.when(F.col("filter") == "PASS", "TP").when(F.col("in_repeat"), "FP").otherwise("FN")
    return reports.outcomes(view(spark, sf_dir, "cand").select((F.col("caller") % 2).alias("caller"), state.alias("state")))


@query(
    """WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents), r AS (SELECT o_orderkey AS region_id, o_orderkey % 200 AS doc_id, o_orderkey * 7 % 9000 AS s, o_orderkey * 7 % 9000 + o_custkey % 25000 AS e FROM orders)
SELECT region_id, length(coalesce(seq, '')[s + 1:e]) AS n, md5(coalesce(seq, '')[s + 1:e]) AS md5 FROM r LEFT JOIN d USING (doc_id)"""
)
def reference_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of all texts as sequences: written as FASTA, read back in chunks, and fetched by region."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seqs = docs.select(F.col("doc_id").cast("string").alias("chrom"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")).where("seq <> ''")
    path = stored_path(spark, "reference")
    reference.wrapped(seqs).write.text(path)
    key = F.col("o_orderkey")
    start = key * 7 % 9000
    regions = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("region_id"), (key % 200).cast("string").alias("chrom"), start.alias("start"), (start + F.col("o_custkey") % 25000).alias("stop"))
    found = reference.fetch(regions, reference.read_fasta(spark, path))
    return found.select("region_id", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("md5"))


@query(sql("cand") + ", m AS (SELECT chrom, start // 100 AS b, sv_type, bit_or(1 << caller) AS mask FROM cand WHERE filter = 'PASS' GROUP BY 1, 2, 3) SELECT mask, count(*) AS n FROM m GROUP BY 1")
def caller_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.caller_overlap(view(spark, sf_dir, "cand"))


@query(sql("ev") + ", c AS (SELECT read_name, array_to_string(list_sort(list(sv_type)), ',') AS pattern FROM ev GROUP BY 1) SELECT pattern, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, pattern LIMIT 8")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight commonest combinations: a report of the top, which is the feature."""
    return reports.patterns(view(spark, sf_dir, "ev").groupBy("read_name").agg(F.collect_list("sv_type").alias("components")), 8)


@query(
    sql("cand")
    + """, p AS (SELECT t.call_id AS t, c.call_id AS c, row_number() OVER (ORDER BY abs(t.start - c.start), t.call_id, c.call_id) AS k FROM cand t JOIN cand c ON t.caller % 2 = 0 AND c.caller % 2 = 1 AND t.chrom = c.chrom AND t.sv_type = c.sv_type
  AND abs(t.start - c.start) <= 500 AND least(greatest(abs(t.size), 1), greatest(abs(c.size), 1)) / greatest(abs(t.size), abs(c.size), 1) >= 0.7),
best AS (SELECT *, k = min(k) OVER (PARTITION BY t) AND k = min(k) OVER (PARTITION BY c) AS ok FROM p),
turn AS (SELECT t, c, k, ok, 0 AS n FROM best UNION ALL
  SELECT t, c, k, k = min(k) OVER (PARTITION BY t) AND k = min(k) OVER (PARTITION BY c), n FROM (SELECT t, c, k, n + 1 AS n, bool_or(ok) OVER (PARTITION BY t) AS a, bool_or(ok) OVER (PARTITION BY c) AS b FROM turn) WHERE NOT a AND NOT b),
met AS (SELECT t, c FROM turn WHERE ok)
SELECT chrom, sv_type, call_id AS truth_id, met.c AS call_id, CASE WHEN met.c IS NULL THEN 'FN' ELSE 'TP' END AS state FROM cand LEFT JOIN met ON met.t = call_id WHERE caller % 2 = 0
UNION ALL SELECT chrom, sv_type, NULL, call_id, 'FP' FROM cand WHERE caller % 2 = 1 AND call_id NOT IN (SELECT c FROM met)"""
)
def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two callers as truth and calls."""
    rows = view(spark, sf_dir, "cand").withColumnRenamed("call_id", "id")
    return evaluation.match(rows.where("caller % 2 = 0"), rows.where("caller % 2 = 1"))


@query(
    sql("cand")
    + """, k AS (SELECT DISTINCT CAST(support AS bigint) AS k FROM cand) SELECT k, round(list_sum(list_transform(range(0, k + 1), lambda i: exp(-15e0 + i * ln(15e0) - lgamma(i + 1)))), 9) AS cdf FROM k"""
)
def poisson_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = view(spark, sf_dir, "cand").select(F.col("support").cast("bigint").alias("k")).distinct()
    return k.select("k", F.round(statistics.poisson_cdf(F.col("k"), F.lit(15.0)), 9).alias("cdf"))


def _after_use(text: str) -> str:
    return text.partition(USABLE)[2]


COVERAGE = f"""{MEANS}, {BY_COUNT}, rm AS (SELECT mean, row_number() OVER (ORDER BY mean) AS i, count(*) OVER () AS n FROM means WHERE mean BETWEEN 0.5 AND 500),
mid AS (SELECT quantile_cont(mean, 0.5) AS c FROM rm WHERE n >= 5 AND i > n // 5 AND i <= n - n // 5), est AS MATERIALIZED (SELECT coalesce(mid.c, CASE WHEN b.c BETWEEN 1 AND 200 THEN b.c END, 30.0) AS coverage FROM mid, bycount b)"""
SCORED = QUAL.replace("15.0 *", "(SELECT coverage FROM est) / 2 *").replace("FROM cand", "FROM typed").replace("cast(support AS bigint)", "cast(floor(support) AS bigint)")


@query(
    sql("aln", "contigs", "rep")
    + f", {USABLE}"
    + _after_use(SA)
    + _after_use(SEGMENTS)
    + _after_use(DEPTHS)
    + COVERAGE
    + f", {whole_caller.EVIDENCE}"
    + CLUSTERED
    + f", {whole_caller.CALLS}, {whole_caller.TYPED}{SCORED}, {whole_caller.FILTERED}"
)
def call_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole caller, from alignments to filtered calls. Two shared reads make an event, as the test tables have no fourteen."""
    found = caller.call_variants(view(spark, sf_dir, "aln"), contigs(spark, sf_dir), view(spark, sf_dir, "rep"), p=Params(complex_reads=2))
    plain = ("sv_type", "chrom", "start", "stop", "size", "support", "mapq", "alt_support", "ref_support", "genotype", "genotype_qual", "forward", "reverse", "in_repeat")
    return found.select(*plain, F.round("af", 6).alias("af"), F.round("qual", 3).alias("qual"), "filter")
