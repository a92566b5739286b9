"""The registered queries of the training-data operators, each over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import graph_search, language_id, licenses, packing, sharding, simhash, substring_dedup, token_files, tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir), 3, 3)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), 35)


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir), 24)


def op6_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_licenses, op4_substring_dedup, op5_jump_sharding, op6_graph_search, op7_bpe_codec, op8_packing, op9_exact_dedup, op10_token_files)}
ORACLES = {"op3_licenses": licenses.oracle_sql(), "op4_substring_dedup": substring_dedup.ORACLE_SQL, "op9_exact_dedup": exact.ORACLE_SQL}
