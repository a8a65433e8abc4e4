"""Operator 4: mixing sources to target weights by Poisson replication.

A source with n rows, a share w of the target and a target size T should be repeated T x w / n times on average: its rate. Each document
draws its count from a Poisson distribution with that mean by inversion: a hash of the seed and its id gives a number in [0, 1), and the count
is how many values of the cumulative distribution do not exceed it. Rates over RATE_PART are sums of several smaller draws, so that no
probability underflows. Documents are exploded by their counts and dealt over all partitions by a hash of id and copy, and sorted by it there:
a global shuffle that comes out the same on every run and on a lost executor's second attempt.

Rates are one row a source. They are broadcast if there are at most BROADCAST_SOURCES of them; beyond that, documents meet them in a salted
join. All of it is DataFrame expressions, so any column is carried along.

Without given weights the shares are proportional to n ** temper. Edge cases: a null source is a source of its own; sources that are not
among given weights get none; rows with the same id in one source draw the same count; rows without an id are told apart by all their columns,
and equal ones by a number from 0, so each draws for itself: equal rows are counted before the shuffle and dealt out again in blocks, so that
no task holds them all; texts play no part, so null, empty and long ones are like any other; the added columns are named copy and shuffle_key,
and columns of those names in docs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join

RATE_PART = 16.0
BROADCAST_SOURCES = 10_000
BLOCK = 65_536  # equal rows without an id that are dealt out as one


def _source(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("-"))


def named(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """row, _source, _name: the rows of docs and what their draws hang on, the id, or without one all columns and a number among equal rows."""
    row, name = F.struct(*docs.columns).alias("row"), F.col(id_col).cast("string")
    others = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(docs.columns) if c != id_col))
    known = docs.where(name.isNotNull()).select(row, _source(source_col).alias("_source"), name.alias("_name"))
    equal = docs.where(name.isNull()).groupBy(row, _source(source_col).alias("_source"), F.md5(others.cast("binary")).alias("_digest")).agg(F.count("*").alias("_n"))
    blocks = equal.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(BLOCK)))).repartition("_digest", "_from")
    numbers = blocks.withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + BLOCK, "_n") - 1)))
    return known.unionAll(numbers.select("row", "_source", F.concat(F.lit("null"), "_digest", F.lit("."), F.col("_nth").cast("string"))))


def uniform(seed: int, name: Column, part: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the hash of seed, name and part."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), name, part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until the rest is below what a uniform number can tell."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["sums"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, target: int | None = None, temper: float = 0.5, source_col: str = "source") -> DataFrame:
    """_source, _rate, _parts, _cdf: one row a source."""
    counts = docs.groupBy(_source(source_col).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.pow("_n", F.lit(temper)))
    else:
        known = [("-" if k is None else f"s{k}", float(w)) for k, w in weights.items()]
        given = docs.sparkSession.createDataFrame(known, "_source string, _w double")
        counts = counts.join(given, "_source", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    sums = counts.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_weight"))  # one row
    size = F.lit(target) if target is not None else F.col("_all")
    rated = counts.crossJoin(F.broadcast(sums))
    rated = rated.withColumn("_rate", F.when(F.col("_weight") > 0, F.round(size * F.col("_w") / F.col("_weight") / F.col("_n"), 9)).otherwise(0.0))
    rated = rated.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / RATE_PART)).cast("int"))
    return rated.select("_source", "_rate", "_parts", cumulative(F.col("_rate") / F.col("_parts")).alias("_cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, target: int | None = None, temper: float = 0.5, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row as often as it is drawn, in a global order by shuffle_key; copy counts a row's repetitions from 0."""
    docs = docs.drop("copy", "shuffle_key")
    rated = rates(docs, weights, target, temper, source_col)
    few = rated.agg(F.count("*")).first()[0] <= BROADCAST_SOURCES
    rows = named(docs, id_col, source_col)
    met = rows.join(F.broadcast(rated), "_source") if few else salted_join(rows, rated, "_source", "_name")
    parts = F.sequence(F.lit(0), F.col("_parts") - 1)
    draws = F.transform(parts, lambda p: (u := uniform(seed, F.col("_name"), p)) * 0 + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)))
    copies = F.aggregate(draws, F.lit(0.0), lambda a, x: a + x).cast("int")
    drawn = met.withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "_name", F.col("copy").cast("string")))
    out = drawn.select("row.*", "copy", F.substring(key, 1, 16).alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = """
WITH digests AS (SELECT *, md5(concat_ws('|', coalesce(lang, '-'), coalesce(n_chars::VARCHAR, '-'), coalesce(source, '-'), coalesce(text, '-'))) AS digest FROM documents),
named AS (
  SELECT * EXCLUDE (digest), coalesce('s' || source, '-') AS src,
    coalesce(doc_id::VARCHAR, 'null' || digest || '.' || (row_number() OVER (PARTITION BY doc_id, digest) - 1)) AS name FROM digests
),
counts AS (SELECT coalesce('s' || source, '-') AS src, count(*) AS n FROM documents GROUP BY 1),
sums AS (SELECT sum(n) AS everything, sum(pow(n, 0.5)) AS weight FROM counts),
rated AS (SELECT src, round(everything * pow(n, 0.5) / weight / n, 9) AS rate FROM counts, sums),
parted AS (SELECT src, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rated),
terms AS (SELECT src, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM parted, range(0, 200) AS r(k)),
cdf AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
draws AS (
  SELECT d.name, d.src, p.part, ('0x' || substr(md5('42|' || d.name || '|' || p.part), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT name, src FROM named) d JOIN parted USING (src), range(0, parted.parts) AS p(part)
),
copies AS (
  SELECT d.name, d.src, count(*) AS n FROM draws d JOIN cdf ON d.src = cdf.src AND cdf.c <= d.u AND cdf.k < 190 GROUP BY 1, 2
)
SELECT d.* EXCLUDE (name, src), c.copy::INT AS copy, substr(md5('order42|' || d.name || '|' || c.copy), 1, 16) AS shuffle_key
FROM named d JOIN copies k ON d.name = k.name AND d.src = k.src, range(0, k.n) AS c(copy)
"""
