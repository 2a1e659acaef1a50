"""Linear pairwise ranker trained on all pairs of a request without forming a pair.

Loss: sum over requests and over pairs (i, j) of one request with
label_i > label_j of  w_ij * exp(score_j - score_i),  w_ij = (gain_i - gain_j) /
ideal DCG of the request, gain = 2^label - 1, ideal DCG over ``max_position``
rows.  The exponential splits into per-(request, label) sums, of weights and of
weighted feature vectors, so one pass covers every pair exactly and work is
linear in the rows.  Requests are packed into blocks once (``request_blocks``),
so a pass moves no row; a request too large for a block combines before a
shuffle of its sums.  Features are centred per request, which no pair notices
and which keeps the exponentials in range.  Labels are grades (a few distinct
values).  The ranker is linear, it is not a boosted tree ranker.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.functions import arrays
from rankloom.functions.scalars import position_discount
from rankloom.functions.vectors import to_array
from rankloom.operators.chunks import stored
from rankloom.operators.request_blocks import REQUEST_BYTES, large_requests, packed, packing_parts, summed
from rankloom.session import scratch_path, shuffles_removed
from rankloom.sources.files import delete_path


@dataclass
class PairwiseRanker:
    means: list[float]
    scales: list[float]
    weights: list[float]
    losses: list[float]

    def score_column(self, features: str) -> Column:
        w = [float(a / s) for a, s in zip(self.weights, self.scales)]
        shift = float(np.dot(w, self.means))
        return arrays.dot(F.col(features), F.array(*[F.lit(v) for v in w])) - F.lit(shift)

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        flat = to_array(df.withColumn("_x", F.col(features)), "_x")
        return flat.withColumn(out, self.score_column("_x")).drop("_x")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [(json.dumps(self.__dict__),)]
        spark.createDataFrame(row, "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> PairwiseRanker:
        spark = SparkSession.getActiveSession()
        return PairwiseRanker(**json.loads(spark.read.parquet(f"{path}/metadata").first()[0]))


def ideal_dcg(df: DataFrame, group: str, label: str, max_position: int) -> DataFrame:
    """(group, ideal) from label counts: at most one row per (group, label) is ordered."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(group).orderBy(F.col(label).desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = F.least(F.coalesce(F.sum("_c").over(earlier), F.lit(0)), F.lit(max_position))
    spans = counts.withColumn("_from", first).withColumn("_to", F.least(F.col("_from") + F.col("_c"), F.lit(max_position)))
    places = F.when(F.col("_to") > F.col("_from"), F.sequence(F.col("_from") + 1, F.col("_to"))).otherwise(
        F.array().cast("array<bigint>")
    )
    worth = arrays.array_sum(F.transform(places, position_discount))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1.0
    return spans.select(group, (gain * worth).alias("_d")).groupBy(group).agg(F.sum("_d").alias("ideal"))


def _standardized(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    vector = array_to_vector(F.col(features))
    row = df.select(Summarizer.metrics("mean", "std").summary(vector).alias("s")).select("s.mean", "s.std").first()
    scales = np.array(row["std"].toArray())
    scales[scales == 0] = 1.0
    return np.array(row["mean"].toArray()), scales


def train_pairwise_ranker(
    df: DataFrame,
    group: str,
    label: str = "label",
    features: str = "features",
    max_position: int = 20,
    iterations: int = 20,
    step: float = 1.0,
    reg: float = 1e-6,
) -> PairwiseRanker:
    """Gradient descent with step halving; each iteration is one distributed aggregation over stored rows, which go at the end."""
    require_columns(df, [group, label, features])
    rows = to_array(df.select(group, F.col(label).cast("double").alias("_y"), features), features)
    rows = rows.withColumn(features, F.col(features).cast("array<double>"))
    spark = rows.sparkSession
    with shuffles_removed(spark):
        means, scales = _standardized(rows, features)
        width = len(means)
        # read once per iteration, so the prepared rows are stored instead of recomputed
        rows, path = rows.where(F.col(group).isNotNull()), scratch_path(spark, "ranker")
        try:
            large, total = large_requests(rows, group, max(1, REQUEST_BYTES // (8 * (width + 1))), f"{path}/found")
            rest = rows if large is None else rows.join(F.broadcast(large), group, "left_anti")
            blocks = packed(rest, group, "_y", features, width, max_position, packing_parts(rows, total, width))
            blocks = stored(blocks, f"{path}/blocks")
            if large is not None:
                large = rows.join(F.broadcast(large), group, "left_semi")
                large = stored(centred(large, group, features, scales, max_position), f"{path}/large")
            return _descend(blocks, large, group, means, scales, iterations, step, reg)
        finally:
            delete_path(spark, path)


def centred(rows: DataFrame, group: str, features: str, scales: np.ndarray, max_position: int) -> DataFrame:
    """(request, label, features in standard deviations from the middle of the request, 1 / ideal DCG)."""
    ideal = ideal_dcg(rows, group, "_y", max_position).where("ideal > 0")
    slots = range(len(scales))
    centre = rows.groupBy(group).agg(*[F.avg(F.get(features, F.lit(i))).alias(f"_m{i}") for i in slots])
    centre = centre.select(group, F.array(*[f"_m{i}" for i in slots]).alias("_m"))
    joined = rows.join(ideal, group).join(centre, group)
    spread = F.array(*[F.lit(float(v)) for v in scales])
    offset = F.zip_with(F.zip_with(features, "_m", lambda x, m: x - m), spread, lambda x, sd: x / sd)
    return joined.select(group, "_y", offset.alias("_x"), (1.0 / F.col("ideal")).alias("_g"))


def level_sums(rows: DataFrame, group: str, w: np.ndarray) -> DataFrame:
    """(loss, g0, g1, ...) of each request and label of ``centred`` rows, which combine before the shuffle."""
    width = len(w)
    s = arrays.dot(F.col("_x"), F.array(*[F.lit(float(v)) for v in w]))
    x = [F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(width)]
    scored = rows.select(group, "_y", "_g", *x, F.exp(-s).alias("_down"), F.exp(s).alias("_up"))
    # plain sums: they stay in generated code and in a hash table, which summaries of vectors do not
    pulled = [F.sum(F.col(f"_x{i}") * F.col("_down")).alias(f"_a{i}") for i in range(width)]
    pushed = [F.sum(F.col(f"_x{i}") * F.col("_up")).alias(f"_b{i}") for i in range(width)]
    levels = scored.groupBy(group, "_y").agg(
        F.sum("_down").alias("_a"), F.sum("_up").alias("_b"), F.max("_g").alias("_each"), *pulled, *pushed
    )
    levels = levels.withColumn("_gain", F.pow(F.lit(2.0), F.col("_y")) - 1.0)
    lower = Window.partitionBy(group).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy(group).orderBy("_y").rowsBetween(1, Window.unboundedFollowing)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    below = F.col("_gain") * total("_b", lower) - total(F.col("_gain") * F.col("_b"), lower)
    above = total(F.col("_gain") * F.col("_a"), upper) - F.col("_gain") * total("_a", upper)
    # how strongly the rows of this level are pulled up and pushed down; both are >= 0
    pull, push = (F.greatest(v, F.lit(0.0)) * F.col("_each") for v in (below, above))
    forces = levels.withColumns({"_pull": pull, "_push": push})
    slots = [(F.col(f"_b{i}") * F.col("_push") - F.col(f"_a{i}") * F.col("_pull")).alias(f"g{i}") for i in range(width)]
    return forces.select((F.col("_a") * F.col("_pull")).alias("loss"), *slots)


def _descend(
    blocks: DataFrame, large: DataFrame | None, group: str, means: np.ndarray, scales: np.ndarray, iterations: int, step: float, reg: float
) -> PairwiseRanker:
    names = ["loss", *[f"g{i}" for i in range(len(means))]]

    def loss_and_gradient(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = summed(blocks, scales, w)
        if large is not None:
            sums = sums.unionByName(level_sums(large, group, w))
        row = sums.agg(*[F.sum(c).alias(c) for c in names]).first()
        if not row["loss"]:
            raise ValueError("no request has two different labels")
        gradient = np.array([row[c] for c in names[1:]])
        return row["loss"] + 0.5 * reg * float(w @ w), gradient + reg * w

    w = np.zeros(len(means))
    loss, gradient = loss_and_gradient(w)
    losses, rate = [loss], step
    for _ in range(iterations):
        norm = np.linalg.norm(gradient)
        if norm == 0 or rate < 1e-6:
            break
        tried = w - rate * gradient / norm
        new_loss, new_gradient = loss_and_gradient(tried)
        if new_loss < loss:
            w, loss, gradient = tried, new_loss, new_gradient
            losses.append(loss)
            rate *= 1.2
        else:
            rate *= 0.5
    return PairwiseRanker(means.tolist(), scales.tolist(), w.tolist(), losses)


