"""A training corpus from raw documents: rules, near-duplicates, leaks, mixture, token blocks.

STAGES are functions of (spark, docs, sf_dir). run() writes what each returns as Parquet in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvaflow.llm import queries
from sylvaflow.llm.decontaminate import without_leaks
from sylvaflow.llm.mixing import mixed
from sylvaflow.llm.near_dup import one_of_each
from sylvaflow.llm.quality import kept_by_quality
from sylvaflow.llm.tables import shared_path, stored
from sylvaflow.llm.token_blocks import read_blocks, write_blocks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_by_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Good texts stay, and no domain is repeated to meet its weight: that would undo the near-dedup."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.WEIGHTS, growth=1.0)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-blocks")
    write_blocks(docs, queries.VOCABULARY, path)
    return read_blocks(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token blocks", token_blocks),
]

#: Divergences, the fitted classifier and the encoding have no SQL form; tests hold the stages of run() against each other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
