"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe_tree, itq, jaccard_join, language_id, matroska, packing, secrets, substring_dedup, token_counts, url_filter

from recordloom.llm.oracle import ORACLE  # noqa: F401


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(_docs(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), "byte_bpe_50k.json").withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), "word_bpe_49k.json")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_docs(spark, sf_dir), digest=True).withColumnRenamed("id", "doc_id")


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(_docs(spark, sf_dir), "byte_bpe_multi_50k.tiktoken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_matroska, op3_token_counts, op4_packing, op5_substring_dedup, op6_bpe_tree, op7_url_filter, op8_jaccard_join, op9_itq, op10_secrets, pipeline)}