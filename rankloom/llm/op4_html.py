"""Query op4: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.html_text import extract_pages


@query("op4_html")
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_pages(pages)
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
