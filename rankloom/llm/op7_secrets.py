"""Query op7: secrets in all documents."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.secret_labels import by_form, planted_findings
from rankloom.llm.secrets import Words, candidates, corpus_words, fit_forest, judge, stored_candidates


def trained(docs: DataFrame, found: DataFrame, words: Words, seed: int = 1) -> Model:
    """The forest for a corpus without labels: planted findings, and candidates whose form proves them."""
    planted = planted_findings(docs, "text", "source", seed=seed)
    mine = candidates(planted, "planted", "text", "path", words, ["label"]).where(F.col("value") == F.col("id"))
    columns = [c for c in found.columns if c != "id"]
    return fit_forest(mine.select(*columns, "label").unionByName(by_form(found).select(*columns, "label")))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = corpus_words(docs, "text")
    found = stored_candidates(docs, "doc_id", "text", "source", words)
    judged = judge(found, trained(docs, found, words))
    return judged.select(
        F.col("id").alias("doc_id"), "start", "length", "name", F.sha2("value", 256).alias("value_sha256"), "probability", "secret"
    )
