"""Expressions over fixed-width arrays, id sequences and class-score vectors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.scalars import clip


def offsets_of(widths: Sequence[int]) -> list[int]:
    """Start position of each field when fields of these widths are laid side by side."""
    return [0, *accumulate(widths)][:-1]


def field_slices(vector: Column, fields: Sequence[tuple[str, int]]) -> list[Column]:
    """One named array column per (name, width), cut from a concatenated vector."""
    starts = offsets_of([w for _, w in fields])
    return [F.slice(vector, s + 1, w).alias(n) for s, (n, w) in zip(starts, fields)]


def concat_as(cols: Sequence[Column], element_type: str = "float") -> Column:
    return F.concat(*[c.cast(f"array<{element_type}>") for c in cols])


def offset_encode(ids: Column, dims: Sequence[int], clamp: bool = True) -> Column:
    """Move the i-th id into its own range of one shared vocabulary."""
    total = sum(dims)
    starts = F.array(*[F.lit(o).cast("bigint") for o in offsets_of(dims)])
    shifted = F.zip_with(ids.cast("array<bigint>"), starts, lambda v, o: v + o)
    if not clamp:
        return shifted
    return F.transform(shifted, lambda v: clip(v, 0, total - 1))


def offset_by_rule(ids: Column, width: int) -> Column:
    """Offset encoding of fields that all have the same vocabulary width."""
    return F.transform(ids, lambda v, i: v.cast("bigint") + i.cast("bigint") * F.lit(width))


def clip_all(values: Column, lo: float, hi: float) -> Column:
    return F.transform(values, lambda v: clip(v, lo, hi))


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sequence_mask(seq: Column, strict_positive: bool = True) -> Column:
    """1 for a real id, 0 for padding; the two-tower side treats any nonzero id as real."""
    keep = (lambda v: v > 0) if strict_positive else (lambda v: v != 0)
    return F.transform(seq, lambda v: keep(v).cast("int"))


def valid_length(seq: Column) -> Column:
    return F.size(F.filter(seq, lambda v: v > 0))


def pad_right(seq: Column, width: int, fill: int = 0) -> Column:
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(seq))
    return F.concat(F.slice(seq, 1, width), F.array_repeat(F.lit(fill).cast("bigint"), missing))


def multi_hot(labels: Column, vocabulary: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.array_contains(labels, v), F.lit(False)).cast("int") for v in vocabulary])


def zero_slots(vector: Column, slots: Sequence[int]) -> Column:
    """Same length, chosen positions set to 0."""
    if not slots:
        return vector
    chosen = F.array(*[F.lit(int(s)) for s in slots])
    return F.transform(vector, lambda v, i: F.when(F.array_contains(chosen, i), F.lit(0.0)).otherwise(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def join_as_text(values: Sequence[Column], sep: str = ",", fill: str = "-1") -> Column:
    """Fixed-width text of integers; NULL takes ``fill`` so later positions never shift."""
    return F.array_join(F.array(*[v.cast("bigint").cast("string") for v in values]), sep, fill)
