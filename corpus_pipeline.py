"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, personal data, packing, each on what the one before kept."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docgrid.llm import linededup, minhash, packing, pii, toxicity
from docgrid.llm.common import saved_alone


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go; the model learns from the labels table."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzily repeated lines stay in their first document only; documents left with nothing go."""
    return linededup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest doc_id stays."""
    return minhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; all documents stay."""
    return pii.without_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row_no")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Hashing, random fields and differencing are no SQL; tests hold lines and near duplicates to brute force, personal data to one plain pass of the chain, packing to its contract and toxicity to held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows written as Parquet and read again; what a stage wrote besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved_alone(partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
