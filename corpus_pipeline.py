"""The corpus pipeline: its stages, in order, over `documents`.

Quality classification, near-duplicate removal, mixing of sources and packing. Each stage works on all rows its predecessor kept, and its
result is a Parquet table in the cluster's shared folder, so a lost executor costs no more than a stage's own tasks. Near-duplicates are
texts whose sets of five-word shingles have similarity 0.8 or more, found by operator 10's fuzzy hash keys. All stages but the last return the
columns of documents.

Edge cases are those of the operators: nulls, empty and very long texts, repeated rows and empty tables pass through every stage; documents
without an id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breakwater.llm import mixing, packing, quality, similar_text
from breakwater.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return similar_text.first_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, in a global order."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # the classifier, the fingerprints and the tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return out
