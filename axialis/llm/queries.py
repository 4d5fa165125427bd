"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, media, mixing, near_dedup, pii, quality, suffix_dedup, token_count, token_files, toxicity
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies are at most two, as targets are at most twice a source's size."""
    out = mixing.mix_report(documents(spark, sf_dir))
    times = [F.round(F.try_element_at("positions", F.lit(k)), 7).alias(name) for k, name in ((1, "position"), (2, "position_2"))]
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "copies", *times)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("similarity", F.round("similarity", 9))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without n_links and best, which depend on the pairs that were tried and so aren't those of the SQL."""
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("n_links", "best")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_mixing, op3_decontamination, op4_token_counts, op5_near_dedup, op6_token_files, op7_pii, op8_media, op9_quality, op10_toxicity)}
SQL = {"op1_suffix_dedup": suffix_dedup.REPEATS_SQL, "op2_mixing": mixing.MIX_SQL, "op3_decontamination": decontaminate.CONTAMINATION_SQL, "op5_near_dedup": near_dedup.CLASSES_SQL}
