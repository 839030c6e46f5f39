"""A corpus pipeline over the table ``documents``: each stage reads what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanframe.functions.cluster import own_folder
from scanframe.llm import bpe, line_dedup, minhash, mixing, toxicity
from scanframe.llm.common import table


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", toxic_filter),
    ("line_dedup", repeated_lines),
    ("minhash_dedup", near_duplicates),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL can express neither the trained score nor the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder; each result is written to the shared folder and read again."""
    folder = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
