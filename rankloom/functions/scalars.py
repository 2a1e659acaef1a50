"""Scalar feature expressions: clamping, bucketing, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the realtime feature contract.
EQUAL_WIDTH = 5
EQUAL_WIDTH_TOP = 29
LOG_BUCKET_TOP = 30
COUNT_CAP = 1e8
MINUTES_CAP = 129600.0
MINUTES_PER_HOUR = 60
MINUTES_PER_DAY = 1440
DAY_BUCKET_SHIFT = 23


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (least/greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def bucket_equal_width(c: Column, width: int = EQUAL_WIDTH, top: int = EQUAL_WIDTH_TOP) -> Column:
    return F.floor(clip(c.cast("double"), 0.0, float(top)) / F.lit(float(width))).cast("int")


def bucket_log(c: Column, cap: float = COUNT_CAP, top: int = LOG_BUCKET_TOP) -> Column:
    return clip(F.floor(F.log1p(clip(c.cast("double"), 0.0, float(cap)))).cast("int"), 0, top)


def bucket_elapsed(minutes: Column) -> Column:
    """Minutes since an event: hours 0..23 on the first day, then days 24..113."""
    m = clip(minutes.cast("double"), 0.0, MINUTES_CAP)
    hours = F.floor(m / F.lit(float(MINUTES_PER_HOUR)))
    days = F.floor(m / F.lit(float(MINUTES_PER_DAY))) + F.lit(DAY_BUCKET_SHIFT)
    return F.when(m < MINUTES_PER_DAY, hours).otherwise(days).cast("int")


def cap_count(c: Column, top: int = 2) -> Column:
    return clip(c.cast("double"), 0.0, float(top)).cast("int")


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def is_target(label: Column, target) -> Column:
    return (label == F.lit(target)).cast("int")


def parse_pair(c: Column, position: int, sep: str = ";") -> Column:
    """One side of a packed ``score;label`` text."""
    return F.split(c, sep).getItem(position).cast("double")


def position_discount(position: Column) -> Column:
    """Discount of a one-based rank: 1 / log2(rank + 1)."""
    return F.lit(1.0) / F.log2(position.cast("double") + F.lit(1.0))


def key_fraction(key: Column, multiplier: int = 2654435761, modulus: int = 1000) -> Column:
    """Stable pseudo-uniform value in [0,1) from an integer key (multiplicative hash)."""
    return F.pmod(key * F.lit(multiplier), F.lit(modulus)) / F.lit(float(modulus))
