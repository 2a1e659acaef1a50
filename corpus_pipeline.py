"""The corpus pipeline: each stage works on all that its predecessor kept.

All stages but the last return the columns of documents; the last adds where
each row is placed.  ``run`` writes every stage to the shared folder and reads
it again, so a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.decontamination import benchmark_windows, remove_documents
from rankloom.llm.language_id import keep_identified
from rankloom.llm.mixing import mix_documents
from rankloom.llm.near_duplicates import deduplicate
from rankloom.llm.op2_sharding import SHARDS, SLOTS
from rankloom.llm.op10_mixing import MOST, SHARE, WEIGHTS
from rankloom.llm.sharding import place
from rankloom.operators.chunks import written_once


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose text has no letters or whose language stays uncertain."""
    return keep_identified(docs, "doc_id", "lang", "source", "text", by_row=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicate(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    windows = benchmark_windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return remove_documents(docs, "doc_id", "text", windows)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs, "doc_id", "source", "text", WEIGHTS, SHARE, MOST)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their slot and shard; copies of a document share a shard."""
    return place(docs, "doc_id", SHARDS, SLOTS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: components of graphs and trained models are beyond plain SQL; the tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
