"""What the corpus operators share: tables in the cluster's shared folder, splits by checksum, runs of equal keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a warehouse folder where it is unset and all run on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither recompute it nor need the executors that made it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    for df in frames:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs run inside pass rows to Python in batches of that many bytes: for rows of megabytes, of which a batch by default holds 64 MB in the
    JVM and again in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, salts: int = 8) -> DataFrame:
    """Inner join of many rows a key with one row a key, each key dealt over `salts` tasks by the column `spread`: a key that holds a
    third of the rows is then no task of its own. `one` is repeated `salts` times."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def checksum_class(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ after lower-casing A-Z only; bytes.lower and bytes.split do exactly that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def key_runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[pa.Table]:
    """Cuts key-sorted batches between keys only, so that no run of equal keys is split over two tables; but a run of `most` rows or more,
    if given, comes in several tables."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        col = now[key].to_numpy()
        cut = int(np.searchsorted(col, col[-1]))
        if most and now.num_rows - cut >= most:
            cut = now.num_rows
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest
