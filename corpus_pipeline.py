"""A corpus pipeline of five of the operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import decontaminate, mixing, sharding, simhash, toxicity
from grainwise.llm.common import keep


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = toxicity.toxicity(docs, model)
    return judged.where("predicted = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 3-word shingles, 3 bits."""
    return simhash.first_of_groups(docs, words=3, bits=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    draw = mixing.random_number(F.col("doc_id"), F.col("source"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    mixed = mixing.mix_sources(docs, "source", mixing.word_count(F.col("text")), draw)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mix.copies")))
    return mixed.where("mix.copies > 0").withColumn("mix", copies).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, slot and the shard among one more."""
    return sharding.shard_rows(docs, "doc_id", 16)


STAGES = [
    ("toxicity", toxic_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Models and fingerprints have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
