"""Query op6: the language of all documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.html_text import extract_pages
from rankloom.llm.language_id import declared_in, identify
from rankloom.llm.url_filter import url_host
from rankloom.operators.chunks import written_once


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have a declared language and a source, which takes the host's place; pages have all four kinds of evidence."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(None).cast("bigint").alias("page_id"), F.col("lang").alias("declared"), F.col("source").alias("host"), "text"
    )
    pages = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), declared_in(F.col("html")).alias("declared"), "html")
    pages = written_once(extract_pages(pages), "page-text")
    rows = docs.unionByName(pages.select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", "declared", "host", "text"))
    return identify(rows)
