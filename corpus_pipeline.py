"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; all but the last return the columns
of `documents`. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axialis.llm.common import documents, remove, shared_folder
from axialis.llm.decontaminate import drop_contaminated
from axialis.llm.mixing import mix_rows
from axialis.llm.near_dedup import keep_one
from axialis.llm.token_files import tokens_round_trip
from axialis.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return mix_rows(docs)


def written_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the rows of a Parquet table were written; None for a frame that isn't read from one."""
    file = F.col("_metadata.file_name")
    order = [F.regexp_extract(file, "part-([0-9]+)", 1).try_cast("long"), file, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return None
    return order


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' index, read back from the files, which hold the documents in the order of training."""
    import public_tokenizers

    return tokens_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), order=written_order(docs))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = shared_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        used.append(path)
        if len(used) > 1:
            remove(spark, used[-2])
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, used[-1])  # the token files are written
    return out
