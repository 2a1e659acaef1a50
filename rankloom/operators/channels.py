"""Channel analytics over activation maps in long form (image, channel, value, class)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.chunks import exact_quantiles


def channel_thresholds(
    maps: DataFrame, channel: str = "channel", value: str = "value", rate: float = 0.005, exact: bool = True
) -> DataFrame:
    """(channel, threshold): the (1 - rate) percentile over all images and positions."""
    if exact:
        found = exact_quantiles(maps, value, [1.0 - rate], [channel])
        return found.select(channel, F.col("value").alias("threshold"))
    return maps.groupBy(channel).agg(F.percentile_approx(value, 1.0 - rate, 10_000).cast("double").alias("threshold"))


def channel_class_means(maps: DataFrame, image: str, channel: str, value: str, label: str) -> DataFrame:
    """Mean over a class's images of the per-image summed activation, per channel; NULL is a class like any other."""
    v = F.col(value).cast("double")
    # images are told apart before anything is counted, so their rows combine in the first step
    images = maps.select(F.col(label).alias("_l"), image).distinct().groupBy("_l").agg(F.count(image).alias("_images"))
    sums = maps.groupBy(label, channel).agg(F.sum(v).alias("_sum"))
    return sums.join(images, F.col(label).eqNullSafe(F.col("_l"))).select(label, channel, (F.col("_sum") / F.col("_images")).alias("mean"))


def channel_class_belonging(
    maps: DataFrame, image: str = "image", channel: str = "channel", value: str = "value", label: str = "label"
) -> DataFrame:
    """(channel, belongs): the class with the greatest mean activation; the lowest class on ties."""
    means = channel_class_means(maps, image, channel, value, label)
    best = F.max(F.struct(F.col("mean"), (-F.col(label)).alias("_neg")))
    return means.groupBy(channel).agg(best.alias("_b")).select(channel, (-F.col("_b._neg")).alias("belongs"))


def topk_per_class(
    weights: DataFrame, k: int = 3, label: str = "label", channel: str = "channel", weight: str = "weight"
) -> DataFrame:
    """The k channels with the largest weight of each class (ties: lower channel)."""
    order = Window.partitionBy(label).orderBy(F.col(weight).desc(), F.col(channel).asc())
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
