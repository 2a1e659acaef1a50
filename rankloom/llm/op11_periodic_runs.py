"""Query op11: periodic runs of words in all documents, a tenth of which repeat a part by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import GAP, query, split_words, table
from rankloom.llm.periodic import greatest_run, run_lines, with_runs


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's text: where crc32 of the id ends in 0, words from some place on repeat with some period.

    A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.array_join(F.transform(words, lambda _, i: F.get(words, source(i.cast("bigint")).cast("int"))), " ")

    words = split_words(text, GAP)
    chosen = (h % 10 == 0) & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = F.get(F.transform(F.array(words), repeated), F.lit(0))  # the words are cut once, not for each place
    return F.when(chosen, once).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = with_runs(docs, "text", ["doc_id"]).withColumn("best", greatest_run(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
