"""Joins that attach side tables to samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.checks import require_columns


def unique_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; a key with several rows fails the job instead of multiplying rows."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_r")
    )
    message = F.concat(F.lit("several rows for key: "), F.to_json(F.struct(*keys)))
    checked = packed.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(True)))
    return checked.where("_ok").select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def reattach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """LEFT join a side table whose keys must be unique."""
    require_columns(df, keys)
    require_columns(side, keys)
    return df.join(unique_on(side, keys), list(keys), "left")


def attach_weight(
    df: DataFrame, weights: DataFrame, keys: Sequence[str], weight: str = "weight", default: float = 1.0
) -> DataFrame:
    """LEFT join the weight table; samples without a weight get ``default``."""
    require_columns(df, keys)
    joined = df.join(unique_on(weights.select(*keys, weight), keys), list(keys), "left")
    return joined.withColumn(weight, F.coalesce(F.col(weight).cast("double"), F.lit(float(default))))


def name_slots(scores: DataFrame, feature_map: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """Name vector slots by position: categories first, then the feature map.

    ``scores`` has (idx, score).  Slots without a name are called ``slot_<i>``;
    two slots with one name both stay.
    """
    shift = len(categories)
    names = feature_map.select((F.col("idx") + F.lit(shift)).cast("int").alias("idx"), "name")
    if categories:
        lead = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("name")) for i, c in enumerate(categories)])
        first = feature_map.sparkSession.range(1).select(F.explode(lead).alias("r")).select("r.*")
        names = first.unionByName(names)
    joined = scores.join(names, "idx", "left")
    fallback = F.concat(F.lit("slot_"), F.col("idx").cast("string"))
    return joined.select("idx", F.coalesce("name", fallback).alias("name"), "score")
