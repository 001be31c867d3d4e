"""The corpus pipeline: quality rules, near duplicates, repeated stretches, benchmark passages, packing.

Every stage works on what the one before it kept; it is written as Parquet and
read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, line_quality, near_dedup, packing, suffix_dedup
from riskloom.llm.queries import default_tokenizer
from riskloom.llm.text import read
from riskloom.session import checkpoint_root, ship_package


#: Percent of the shingles' union that near copies share; op1's 85 is that query's alone.
NEAR_COPY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose base counts and content share pass (see ``line_quality.judge_quality``)."""
    ship_package(spark)
    return line_quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every near-duplicate component."""
    ship_package(spark)
    return near_dedup.without_near_copies(docs, NEAR_COPY)


def repeated_stretches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the stretches that an earlier document has as well."""
    ship_package(spark)
    return suffix_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship_package(spark)
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_stretches", repeated_stretches),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: Viterbi decoding, signatures, hashed suffix sorts and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; the last one's rows are returned."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
