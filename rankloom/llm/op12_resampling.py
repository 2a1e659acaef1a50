"""Query op12: a draw of documents towards the words of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import query, table
from rankloom.llm.resampling import gains, ranked, scored

PERCENT = 5


@query("op12_resampling")
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gain = gains(docs, table(spark, sf_dir, "benchmark"), "text", "text")
    found = ranked(scored(docs, "doc_id", "text", gain), PERCENT)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "n_features", "weight", "score", "rank")
