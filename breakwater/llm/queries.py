"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, html_cut, language_model, licences, mixing, negatives, neighbours, packing, quality, sequences, simhash, spelling
from .common import table


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each whole text are the samples of a recording, in frames of 256 as texts are short: no table has a media column."""
    recordings = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("audio"))
    return audio.align(audio.fingerprint(recordings, "doc_id", "audio", "u8", frame=256))


def op7_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.encode_and_read_back(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_main_text_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_reply_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With conversation -1, a user and an assistant who say control strings."""
    said = F.explode(F.array(*(F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(who).alias("role"), F.lit(chat.SAID).alias("text")) for i, who in enumerate(("user", "assistant")))))
    more = spark.range(1).select(said.alias("x")).select("x.*")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_discriminant": op1_quality_discriminant,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_pitman_yor_scores": op3_pitman_yor_scores,
    "op4_poisson_mixture": op4_poisson_mixture,
    "op5_licence_rules": op5_licence_rules,
    "op6_chroma_alignment": op6_chroma_alignment,
    "op7_arrow_sequences": op7_arrow_sequences,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_main_text_cut": op9_main_text_cut,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_reply_examples": op11_reply_examples,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_nearest_vectors": neighbours.ORACLE,
    "op4_poisson_mixture": mixing.ORACLE,
    "op5_licence_rules": licences.oracle(),
    "op11_reply_examples": chat.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
