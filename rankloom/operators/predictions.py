"""Metrics of multi-class prediction tables before and after an attack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.arrays import argmax


def label_index(label: Column, sparse: bool = True) -> Column:
    """Class number from a class index or a one-hot array."""
    return label.cast("int") if sparse else argmax(label)


def keep_correct(df: DataFrame, scores: str = "clean", label: str = "label", sparse: bool = True) -> DataFrame:
    return df.where(argmax(F.col(scores)) == label_index(F.col(label), sparse))


def keep_untargeted(df: DataFrame, scores: str = "clean", target: str = "target") -> DataFrame:
    """Rows not already predicted as the attack target."""
    return df.where(argmax(F.col(scores)) != F.col(target))


def accuracy(
    df: DataFrame, scores: str, label: str = "label", by: Sequence[str] = (), sparse: bool = True
) -> DataFrame:
    hit = (argmax(F.col(scores)) == label_index(F.col(label), sparse)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def attack_success_rate(
    df: DataFrame,
    by: Sequence[str] = ("epsilon",),
    clean: str = "clean",
    adversarial: str = "adversarial",
    label: str = "label",
    target: str | None = None,
    only_correct: bool = True,
) -> DataFrame:
    """1 - accuracy after the attack, rounded to 4 digits.

    With ``only_correct`` just the originally correct rows count, and with a
    target those already predicted as the target are left out too.
    """
    rows = df
    if only_correct:
        rows = keep_correct(rows, clean, label)
        if target is not None:
            rows = keep_untargeted(rows, clean, target)
    hit = (argmax(F.col(adversarial)) == F.col(label)).cast("double")
    return rows.groupBy(*by).agg(F.round(1.0 - F.avg(hit), 4).alias("success_rate"))


def attack_target_matrix(
    df: DataFrame,
    targets: Sequence[int],
    by: Sequence[str] = ("epsilon",),
    clean: str = "clean",
    adversarial: str = "adversarial",
    label: str = "label",
    target: str | None = None,
    only_correct: bool = True,
) -> DataFrame:
    """(by, origin, target, rate): share of an origin class's rows predicted as each target.

    Without a ``target`` column every adversarial prediction is checked against
    all targets; with one, only the rows attacked towards that target count.
    """
    rows = keep_correct(df, clean, label) if only_correct else df
    predicted = argmax(F.col(adversarial)).alias("_p")
    if target is not None:
        rows = rows.select(*by, F.col(label).alias("origin"), F.col(target).alias("target"), predicted)
        return rows.groupBy(*by, "origin", "target").agg(
            F.round(F.avg((F.col("_p") == F.col("target")).cast("double")), 4).alias("rate")
        )
    rates = [F.round(F.avg((F.col("_p") == t).cast("double")), 4).alias(f"_t{t}") for t in targets]
    wide = rows.select(*by, F.col(label).alias("origin"), predicted).groupBy(*by, "origin").agg(*rates)
    long = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_t{t}").alias("rate")) for t in targets])
    return wide.select(*by, "origin", F.inline(long))
