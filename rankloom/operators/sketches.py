"""Stored sketches of columns, one row for each slice of the data, merged for any range of slices.

Quantiles come from KLL sketches and distinct counts from HyperLogLog sketches,
both made and merged inside Spark.  A question about many days reads their
sketches, some kilobytes each, and not the days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: size parameter of the quantile sketch; a rank is off by about RANK_ERROR of the rows at most (99 % of cases)
KLL_K, RANK_ERROR = 800, 0.005
#: log2 of the buckets of the distinct-count sketch; the relative error of an estimate (three standard deviations)
HLL_LG, DISTINCT_ERROR = 12, 0.05


def sketch_columns(df: DataFrame, slices: Sequence[str], numbers: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """(slices, column, n, missing, quantiles, distinct): one row for each slice and column, in one aggregation.

    ``numbers`` get both sketches, ``values`` only the distinct count.  NULL and
    NaN are counted as missing and enter no sketch.
    """
    aggregates = []
    for c in [*numbers, *values]:
        number = F.col(c).cast("double") if c in numbers else None
        held = F.col(c).isNotNull() & (~F.isnan(number) if number is not None else F.lit(True))
        quantiles = F.kll_sketch_agg_double(F.when(held, number), F.lit(KLL_K)) if number is not None else F.lit(None).cast("binary")
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(held).alias("n"),
                F.count_if(~held).alias("missing"),
                quantiles.alias("quantiles"),
                F.hll_sketch_agg(F.when(held, F.col(c).cast("string")), F.lit(HLL_LG)).alias("distinct"),
            )
        )
    wide = df.groupBy(*slices).agg(F.array(*aggregates).alias("_s"))
    return wide.select(*slices, F.inline("_s"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, missing, quantiles, distinct) over all given rows of ``sketch_columns``."""
    some = F.col("quantiles").isNotNull() & (F.col("n") > 0)
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        # merging nothing gives an empty sketch, which answers no question
        F.when(F.count_if(some) > 0, F.kll_merge_agg_double(F.when(some, F.col("quantiles")), F.lit(KLL_K))).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def sketched_quantiles(merged: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, p, value) of merged sketches; columns without numbers have no rows."""
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.kll_sketch_get_quantile_double("quantiles", ps)
    rows = merged.where(F.col("quantiles").isNotNull() & (F.col("n") > 0))
    return rows.select(*by, "column", F.inline(F.arrays_zip(ps.alias("p"), values.alias("value"))))


def sketched_distinct(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, distinct_values): estimated numbers of distinct values."""
    return merged.select(*by, "column", F.hll_sketch_estimate("distinct").alias("distinct_values"))


def rank_between(column: Column, value: Column) -> tuple[Column, Column]:
    """Shares of the rows below a value and at most at it: a quantile's true rank lies between."""
    return F.avg((column < value).cast("double")), F.avg((column <= value).cast("double"))
