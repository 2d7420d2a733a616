"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the
next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultlens import configure
from vaultlens.llm import decontamination, mixing, near_duplicates, quality
from vaultlens.session import scratch_dir, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines above the limits of their host."""
    configure(spark)
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    ship_package(configure(spark))
    return near_duplicates.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents mostly made of them go."""
    ship_package(configure(spark))
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document taken, its whole epochs and the words of a last part."""
    configure(spark)
    return mixing.sample(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: Cutting passages out of a text until no word is hit is a loop that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
