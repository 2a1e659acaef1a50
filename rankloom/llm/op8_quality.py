"""Query op8: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.quality import judge


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = judge(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (repeated * 100 > n * 50)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality",
    )
