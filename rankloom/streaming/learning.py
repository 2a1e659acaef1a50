"""Incremental dictionary, logistic regression and moving statistics over micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.functions import arrays
from rankloom.functions.scalars import sigmoid
from rankloom.operators.chunks import written_once
from rankloom.operators.embeddings import covariance_of, group_moments, moving_stats
from rankloom.operators.encoders import new_entries
from rankloom.streaming.versions import VersionedTable


def start_batches(stream: DataFrame, handler, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def extend_with_batch(
    batch: DataFrame, batch_id: int, table: VersionedTable, columns: Sequence[str], fold_every: int = 0
) -> None:
    """Number this batch's unseen values and store just the additions as version ``batch_id``."""
    known = table.union_all(below=batch_id)
    table.write(batch_id, new_entries(batch, known, columns))
    table.fold(batch_id, fold_every, lambda df: df)


def stream_extend_dictionary(
    stream: DataFrame, columns: Sequence[str], root: str, checkpoint: str, fold_every: int = 100
) -> StreamingQuery:
    table = VersionedTable(stream.sparkSession, root)
    return start_batches(stream, lambda df, n: extend_with_batch(df, n, table, columns, fold_every), checkpoint)


def read_dictionary(spark: SparkSession, root: str) -> DataFrame | None:
    return VersionedTable(spark, root).union_all()


def logistic_gradient(
    df: DataFrame, weights: np.ndarray, intercept: float, features: str, label: str
) -> tuple[np.ndarray, float, int]:
    """(gradient, intercept gradient, rows) of the mean log loss, in one aggregation."""
    x = F.col(features).cast("array<double>")
    z = arrays.dot(x, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(intercept))
    scored = df.select(x.alias("_x"), F.col(label).cast("double").alias("_y"), sigmoid(z).alias("_p"))
    error = F.col("_p") - F.col("_y")
    # errors scale the vectors: as weights, those of one sign alone would leave the other summary without a row
    pulls = array_to_vector(F.transform("_x", lambda v: v * error))
    sums = scored.groupBy(F.lit(True)).agg(Summarizer.sum(pulls).alias("pull"), F.sum(error).alias("bias"), F.count(F.lit(1)).alias("n"))
    row = sums.first()
    if row is None:
        return np.zeros(len(weights)), 0.0, 0
    return row["pull"].toArray() / row["n"], row["bias"] / row["n"], row["n"]


def sgd_steps(
    df: DataFrame, weights: np.ndarray, intercept: float, features: str, label: str, steps: int, step: float
) -> tuple[np.ndarray, float, int]:
    """``steps`` full-batch gradient steps with step / sqrt(i)."""
    rows = 0
    for i in range(1, steps + 1):
        gradient, bias, rows = logistic_gradient(df, weights, intercept, features, label)
        weights = weights - step / np.sqrt(i) * gradient
        intercept = intercept - step / np.sqrt(i) * bias
    return weights, float(intercept), rows


def train_with_batch(
    batch: DataFrame,
    batch_id: int,
    table: VersionedTable,
    initial: Sequence[float],
    intercept: float,
    features: str,
    label: str,
    steps: int,
    step: float,
) -> None:
    """Continue from the weights stored before this batch and store the new ones as ``batch_id``."""
    before = table.latest(below=batch_id)
    if before is not None:
        row = before.first()
        initial, intercept = row["weights"], row["intercept"]
    batch = batch.persist()
    try:
        weights, bias, n = sgd_steps(batch, np.array(initial, dtype=float), intercept, features, label, steps, step)
    finally:
        batch.unpersist()
    state = [([float(w) for w in weights], float(bias), int(n))]
    table.write(
        batch_id, batch.sparkSession.createDataFrame(state, "weights array<double>, intercept double, n_rows bigint")
    )


def stream_train_lr(
    stream: DataFrame,
    initial: Sequence[float],
    root: str,
    checkpoint: str,
    intercept: float = 0.0,
    features: str = "features",
    label: str = "label",
    steps: int = 1,
    step: float = 0.1,
) -> StreamingQuery:
    """Warm-started logistic regression over a stream of labelled feature arrays."""
    table = VersionedTable(stream.sparkSession, root)
    handler = lambda df, n: train_with_batch(df, n, table, initial, intercept, features, label, steps, step)
    return start_batches(stream, handler, checkpoint)


def slot_means(df: DataFrame, features: str) -> DataFrame:
    """(slot, value): mean of every vector slot."""
    return (
        df.select(F.posexplode(features).alias("slot", "v"))
        .groupBy("slot")
        .agg(F.avg(F.col("v").cast("double")).alias("value"))
    )


def stream_moving_means(
    stream: DataFrame, features: str, root: str, checkpoint: str, momentum: float = 0.99
) -> StreamingQuery:
    """Exponential moving mean of every slot, one version per micro-batch."""
    table = VersionedTable(stream.sparkSession, root)

    def handler(batch: DataFrame, batch_id: int) -> None:
        table.write(batch_id, moving_stats(table.latest(below=batch_id), slot_means(batch, features), ["slot"], momentum))

    return start_batches(stream, handler, checkpoint)


def stream_moving_covariance(
    stream: DataFrame, features: str, m: int, root: str, checkpoint: str, momentum: float = 0.99, epsilon: float = 1e-3, fold_every: int = 100
) -> StreamingQuery:
    """Exponential moving mean and shrunk covariance of groups of ``m`` slots: one version per micro-batch.

    A row is (grp, i, j, value); means have j = -1.  Each batch is read once.
    A batch of one row, or none, moves nothing.
    """
    table = VersionedTable(stream.sparkSession, root)

    def handler(batch: DataFrame, batch_id: int) -> None:
        moments = written_once(group_moments(batch, features, m).where("n > 1"), "moments")
        means = moments.select("grp", F.posexplode("mean").alias("i", "value")).withColumn("j", F.lit(-1))
        both = covariance_of(moments, m, epsilon).withColumnRenamed("cov", "value").unionByName(means)
        table.write(batch_id, moving_stats(table.latest(below=batch_id), both, ["grp", "i", "j"], momentum))

    return start_batches(stream, handler, checkpoint)
