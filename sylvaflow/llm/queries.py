"""The queries of this package: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.llm.decontaminate import leaks
from sylvaflow.llm.html_text import main_text
from sylvaflow.llm.licenses import license_scan
from sylvaflow.llm.lm_score import cross_entropy_difference, target_documents
from sylvaflow.llm.mixing import DOMAINS, mixing_rates
from sylvaflow.llm.near_dup import near_duplicates
from sylvaflow.llm.pii import with_surrogates
from sylvaflow.llm.prefix_trie import TRIE_SQL, prefix_trie
from sylvaflow.llm.quality import quality
from sylvaflow.llm.tables import shared_path
from sylvaflow.llm.token_blocks import read_blocks, write_blocks
from sylvaflow.llm.token_counts import token_counts
from sylvaflow.llm.toxicity import toxicity
from sylvaflow.llm.whitening import whitened

#: Shares of the tokens that each domain shall have.
WEIGHTS = {"good": 0.93, "low": 0.06, "toxic": 0.01}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=0.8)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="a key of these queries")
    number = F.size(F.array_distinct(F.transform("entities", lambda e: e["entity"])))
    return found.select("doc_id", "text", number.cast("long").alias("n_entities"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), least=0.9)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cross_entropy_difference(docs, target_documents(_table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), VOCABULARY, limit=1024)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join("blocks", " ")
    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(_table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "quality.*")


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-blocks")
    write_blocks(_table(spark, sf_dir, "documents"), VOCABULARY, path)
    return read_blocks(spark, path)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), WEIGHTS)
    return found.select("doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_near_dup, op3_surrogates, op4_license_scan, op5_lm_score, op6_token_counts, op7_main_text, op8_quality_rules, op9_token_blocks, op10_mixing, op11_toxicity, op12_prefix_trie, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op12_prefix_trie": TRIE_SQL}
