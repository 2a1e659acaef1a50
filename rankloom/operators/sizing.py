"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: largest side that is copied to every executor, in estimated in-memory bytes
BROADCAST_LIMIT = 128 << 20
ROW_OVERHEAD = 32


def row_bytes(df: DataFrame) -> Column:
    """Estimated size of a row in memory: text by length, arrays by element count, the rest 8 bytes."""
    total = F.lit(ROW_OVERHEAD).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.length(f.name), F.lit(0)) * 4
        elif isinstance(f.dataType, T.ArrayType):
            size = F.greatest(F.size(f.name), F.lit(0)) * 8
        else:
            size = F.lit(8)
        total = total + size
    return total


def measured_bytes(df: DataFrame) -> int:
    """One small aggregation over the candidate side; a single number reaches the driver."""
    return int(df.agg(F.sum(row_bytes(df))).first()[0] or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast when the measured size is within ``limit``.

    A larger side stays a shuffled join, whose very frequent keys adaptive
    execution splits over several tasks.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
