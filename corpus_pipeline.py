"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. A stage starts by dropping the scratch tables of the one before, whose result has been written by then.
All stages but the last return the columns of their input, whatever other columns it has and however they are named.
Null and empty texts are in no language and go with the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from lorewell.llm.common import Scratch, drop_path, shared_folder

#: Share of a text's n-grams that must belong to its language. Texts below are in none of the learned languages.
LEAST_SCORE = 0.3
_scratch = Scratch()


def _stage(f):
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.release(spark)
        with _scratch:
            return f(spark, docs, sf_dir)

    return run


@_stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: texts without letters and texts that match none go."""
    filters = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.keep_known(docs, filters, LEAST_SCORE)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 or more over five-word shingles, the smallest doc_id."""
    return simhash.drop_near_copies(docs, 5, 0.8)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that stand elsewhere too; those that lose all words go."""
    return substring_dedup.drop_repeats(docs, 35, chars_col="n_chars")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


STAGES = [
    ("language id", keep_languages),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]
#: SQL expresses neither the language filters nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. The last one's result reads only its own scratch table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/lorewell-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    result = STAGES[-1][1](spark, docs, sf_dir)
    drop_path(spark, before)
    return result
