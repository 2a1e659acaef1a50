"""Loss values over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.arrays import array_sum
from rankloom.functions.scalars import clip

EPSILON = 1e-7  # fixed value: numeric floor of the training library


def bce_loss(df: DataFrame, label: str = "label", prob: str = "probability") -> DataFrame:
    """Mean binary cross entropy with probabilities kept inside [eps, 1-eps]."""
    p = clip(F.col(prob).cast("double"), EPSILON, 1.0 - EPSILON)
    y = F.col(label).cast("double")
    return df.agg((-F.avg(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("bce"))


def focal_loss(
    df: DataFrame, label: str = "label", prob: str = "probability", gamma: float = 2.0, alpha: float = 0.25
) -> DataFrame:
    p, y = F.col(prob).cast("double"), F.col(label)
    on_pos = F.when(y == 1, p).otherwise(1.0)
    on_neg = F.when(y == 0, p).otherwise(0.0)
    pos_term = F.avg(alpha * F.pow(1.0 - on_pos, F.lit(gamma)) * F.log(on_pos + EPSILON))
    neg_term = F.avg((1.0 - alpha) * F.pow(on_neg, F.lit(gamma)) * F.log(1.0 - on_neg + EPSILON))
    return df.agg((-pos_term - neg_term).alias("focal"))


def dice_loss(df: DataFrame, label: str = "label", prob: str = "probability", smooth: float = 1e-6) -> DataFrame:
    p, y = F.col(prob).cast("double"), F.col(label).cast("double")
    overlap = 2.0 * F.sum(y * p) + smooth
    return df.agg((1.0 - overlap / (F.sum(y * y) + F.sum(p * p) + smooth)).alias("dice"))


def _per_class(scores: Column, label: Column, term) -> Column:
    return F.transform(scores, lambda s, i: term(s.cast("double"), (i == label).cast("double")))


def margin_loss(
    df: DataFrame, scores: str, label: str, upper: float = 0.9, lower: float = 0.1, down_weight: float = 0.5
) -> DataFrame:
    """Mean over rows and classes of the two-sided squared hinge."""

    def term(s: Column, y: Column) -> Column:
        low = F.pow(F.greatest(F.lit(upper) - s, F.lit(0.0)), F.lit(2.0))
        high = F.pow(F.greatest(s - F.lit(lower), F.lit(0.0)), F.lit(2.0))
        return y * low + F.lit(down_weight) * (1.0 - y) * high

    losses = _per_class(F.col(scores), F.col(label), term)
    return df.agg((F.sum(array_sum(losses)) / F.sum(F.size(scores))).alias("margin_loss"))


def spread_margin(step: int) -> float:
    """Margin schedule: 0.2 growing to 0.99 with the training step."""
    import math

    return 0.2 + 0.79 / (1.0 + math.exp(-min(10.0, step / 50000.0 - 4.0)))


def spread_loss(df: DataFrame, scores: str, label: str, margin: float) -> DataFrame:
    """Mean over rows of squared margin violations of the wrong classes against the true class."""
    target = F.element_at(F.col(scores), F.col(label) + 1).cast("double")

    def term(s: Column, y: Column) -> Column:
        return (1.0 - y) * F.pow(F.greatest(F.lit(0.0), F.lit(margin) - (target - s)), F.lit(2.0))

    return df.agg(F.avg(array_sum(_per_class(F.col(scores), F.col(label), term))).alias("spread_loss"))


def distribution_entropy(df: DataFrame, probs: str) -> DataFrame:
    """Mean and population deviation of the Shannon entropy of each row's distribution.

    Rows hold nonnegative weights; they are normalised first and 0 ln 0 is 0.
    """
    total = array_sum(F.transform(probs, lambda v: v.cast("double")))

    def one(v: Column) -> Column:
        p = v.cast("double") / F.col("_t")
        return F.when(p > 0, -p * F.log(p)).otherwise(0.0)

    rows = df.select(F.col(probs), total.alias("_t")).where(F.col("_t") > 0)
    return rows.select(array_sum(F.transform(probs, one)).alias("_h")).agg(
        F.avg("_h").alias("mean_entropy"), F.stddev_pop("_h").alias("std_entropy")
    )
