"""Lines of text files with their places, and text files joined from parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, line: the line's number, from 0, as if the files were one, in the order of their names. Lines are counted by split of a file first,
    so that numbers don't depend on which task reads which split; no line is shuffled."""
    raw = spark.read.text(path).select("value", F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_split"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_id"))
    before = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = raw.groupBy("_split", "file_path", "file_block_start").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    splits = splits.select("_split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    return raw.join(splits, "_split").select("value", (F.col("_id") + F.col("_shift")).alias("line"))


def write_ordered(lines: DataFrame, order: str, path: str, head: Sequence[str] = ()) -> None:
    """One text file of the lines' `value` in the order of the number column `order`, after the lines of head. Parts are written in ranges of the order, by as many tasks
    as there are partitions, and joined at the end by copying their bytes one after the other; nothing but a buffer is in memory."""
    spark = lines.sparkSession
    staged = path.rstrip("/") + "._parts"
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        if head:
            out.write(bytearray("".join(f"{x}\n" for x in head).encode()))
        for part in sorted(str(s.getPath()) for s in fs.listStatus(source)):
            if part.rsplit("/", 1)[1].startswith("part-"):
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                stream.close()
    finally:
        out.close()
    fs.delete(source, True)


def add_csv(rows: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Adds rows to a folder of CSV files with a header. columns: of the rows, and what the header calls them."""
    rows.select(*(F.col(c).alias(title) for c, title in columns.items())).write.mode("append").csv(path, header=True)
