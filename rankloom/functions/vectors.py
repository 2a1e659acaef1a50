"""Conversions at the ML vector boundary."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.mllib.linalg import VectorUDT as LegacyVectorUDT
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rankloom.checks import require_columns


def densify(df: DataFrame, column: str = "features") -> DataFrame:
    """Sparse or dense vectors become dense vectors with the same values."""
    require_columns(df, [column])
    return df.withColumn(column, array_to_vector(vector_to_array(F.col(column))))


def to_ml_vector(df: DataFrame, column: str = "features") -> DataFrame:
    """Accept ML vectors, legacy vectors or numeric arrays; decided from the schema alone."""
    require_columns(df, [column])
    kind = df.schema[column].dataType
    if isinstance(kind, VectorUDT):
        return df
    if isinstance(kind, LegacyVectorUDT):
        return MLUtils.convertVectorColumnsToML(df, column)
    if isinstance(kind, ArrayType):
        return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))
    raise TypeError(f"column {column} is {kind.simpleString()}, not a vector")


def to_array(df: DataFrame, column: str = "features") -> DataFrame:
    if isinstance(df.schema[column].dataType, ArrayType):
        return df
    return df.withColumn(column, vector_to_array(F.col(column)))


def positive_probability(
    df: DataFrame, variant: str = "named", pred_col: str = "predict", prob_col: str = "prob"
) -> DataFrame:
    """Turn a classifier's vector outputs into scalar columns.

    ``rename``: probability = p[1], rawPrediction = the probability vector;
    ``split``: probability = p[1], prediction = raw[1];
    ``named``: pred_col = raw[1], prob_col = p[1], probability dropped.
    """
    require_columns(df, ["probability", "rawPrediction"])
    positive = vector_to_array(F.col("probability"))[1]
    raw = vector_to_array(F.col("rawPrediction"))[1]
    if variant == "rename":
        return df.withColumns({"rawPrediction": F.col("probability"), "probability": positive})
    if variant == "split":
        return df.withColumns({"probability": positive, "prediction": raw})
    if variant == "named":
        return df.withColumns({pred_col: raw, prob_col: positive}).drop("probability")
    raise ValueError(f"unknown variant {variant!r}")
