"""Sinks: compressed tables, stored predictions, embedding text, feature scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.operators.samples import top_n
from rankloom.sources.files import is_complete


def write_compressed(df: DataFrame, path: str, rows_per_file: int | None = None, codec: str = "zstd") -> None:
    writer = df.write.mode("overwrite").option("compression", codec)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a finished table; otherwise build it, write it and read it back."""
    if not is_complete(spark, path):
        write_compressed(build(), path)
    return spark.read.parquet(path)


def predict_and_store(
    score: Callable[[DataFrame], DataFrame],
    df: DataFrame,
    path: str,
    features: str = "features",
    repredict: bool = False,
) -> DataFrame:
    """Scores without the feature vector, stored; evaluation always reads the stored copy."""
    spark = df.sparkSession
    if repredict or not is_complete(spark, path):
        write_compressed(score(df).drop(features), path)
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """user_id, goods_id, label float, probability float rounded to 8 decimals."""
    require_columns(df, ["user_id", "goods_id", "label", "probability"])
    out = df.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("goods_id").cast("string").alias("goods_id"),
        F.col("label").cast("float").alias("label"),
        F.round(F.col("probability").cast("double"), 8).cast("float").alias("probability"),
    )
    write_compressed(out, path)


def embedding_lines(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    values = F.array_join(F.col(vec_col).cast("array<string>"), ",")
    return df.select(F.concat_ws("\t", F.col(id_col).cast("string"), values).alias("value"))


def export_embeddings(
    df: DataFrame, path: str, dt: str, id_col: str = "id", vec_col: str = "embedding", table: str | None = None
) -> None:
    """Text lines ``id TAB v1,v2,...`` under ``dt=<day>``; registers the partition of ``table`` if named."""
    lines = embedding_lines(df, id_col, vec_col).withColumn("dt", F.lit(dt))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").text(path)
    if table is not None:
        df.sparkSession.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (dt = '{dt}') LOCATION '{path}/dt={dt}'")


def write_feature_scores(scores: DataFrame, path: str, shown: int = 100) -> DataFrame:
    """``name TAB score`` lines, best first; returns the ranked first ``shown`` rows."""
    ordered = scores.orderBy(F.col("score").desc(), "name")
    ordered.select(F.concat_ws("\t", "name", F.col("score").cast("string")).alias("value")).write.mode(
        "overwrite"
    ).text(path)
    return top_n(scores, shown, [F.col("score").desc(), F.col("name")])
