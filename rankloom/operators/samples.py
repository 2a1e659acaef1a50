"""Sample-table preparation: filters, splits, sampling, assembling, profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.checks import require_columns, split_names
from rankloom.functions import arrays
from rankloom.functions.vectors import to_array

HASH_BUCKETS = 1 << 20


def hash_fraction(keys: Sequence[str], seed: int = 11) -> Column:
    """Uniform value in [0,1) fixed by the key: the same row always falls on the same side."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(HASH_BUCKETS)) / F.lit(float(HASH_BUCKETS))


def merge_category_features(
    df: DataFrame, categories: str | Sequence[str] | None, features: str = "features", invalid: str = "error"
) -> DataFrame:
    """Prepend category columns (as doubles) to the feature vector; unset means no change."""
    names = split_names(categories)
    if not names:
        return df
    require_columns(df, [*names, features])
    cast = df.withColumns({n: F.col(n).cast("double") for n in names})
    assembler = VectorAssembler(inputCols=[*names, features], outputCol="_merged", handleInvalid=invalid)
    return assembler.transform(cast).drop(features).withColumnRenamed("_merged", features)


def merge_category_arrays(df: DataFrame, categories: str | Sequence[str] | None, features: str) -> DataFrame:
    """Array twin of ``merge_category_features``."""
    names = split_names(categories)
    if not names:
        return df
    require_columns(df, [*names, features])
    head = F.array(*[F.col(n).cast("double") for n in names])
    return df.withColumn(features, F.concat(head, F.col(features).cast("array<double>")))


def excluded_slots(feature_map: DataFrame, names: str | Sequence[str] | None) -> list[int]:
    """Slot numbers of the named features; unknown names are ignored.

    The result is at most as long as ``names``, which is a configuration value.
    """
    wanted = split_names(names)
    if not wanted:
        return []
    rows = feature_map.where(F.col("name").isin(wanted)).select("idx").distinct().collect()
    return sorted(int(r[0]) for r in rows)


def exclude_features(
    df: DataFrame, feature_map: DataFrame, names: str | Sequence[str] | None, features: str = "features"
) -> DataFrame:
    """Zero the named slots of the feature vector; its length does not change."""
    slots = excluded_slots(feature_map, names)
    if not slots:
        return df
    as_vector = df.schema[features].dataType.typeName() != "array"
    out = to_array(df, features).withColumn(features, arrays.zero_slots(F.col(features).cast("array<double>"), slots))
    return out.withColumn(features, array_to_vector(F.col(features))) if as_vector else out


def drop_columns_merge(df: DataFrame, drop: Sequence[str], out: str = "features", fill: str = "-1") -> DataFrame:
    """Join all other columns, as integers in column order, into one comma text.

    NULL becomes ``fill`` so the text always has the same number of fields.
    """
    kept = [c for c in df.columns if c not in set(drop)]
    keys = [c for c in df.columns if c in set(drop)]
    return df.select(*keys, arrays.join_as_text([F.col(c) for c in kept], ",", fill).alias(out))


def stratified_downsample(
    df: DataFrame, label: str, pos_ratio: float, neg_ratio: float, rand: Column | str
) -> DataFrame:
    """Keep label 1 with rand <= pos_ratio and label 0 with rand <= neg_ratio, in one scan.

    ``rand`` is a column in [0, 1); ``hash_fraction`` of the key serves where the data has none.
    """
    r = F.col(rand) if isinstance(rand, str) else rand
    keep_pos = (F.col(label) == 1) & (r <= F.lit(float(pos_ratio)))
    keep_neg = (F.col(label) == 0) & (r <= F.lit(float(neg_ratio)))
    return df.where(keep_pos | keep_neg)


def split_train_test(
    df: DataFrame, fold: int = 1, fraction: Column | None = None, keys: Sequence[str] = (), seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """Disjoint and complete (train, test); test share 1/fold when fold > 1, else 0.3.

    ``fraction`` (or a hash of ``keys``) decides the side, so a re-read or a
    different partitioning never moves a row.  Without either, ``randomSplit``.
    """
    share = 1.0 / fold if fold > 1 else 0.3
    if fraction is None and not keys:
        train, test = df.randomSplit([1.0 - share, share], seed)
        return train, test
    side = fraction if fraction is not None else hash_fraction(keys, seed)
    return df.where(side >= share), df.where(side < share)


def file_split(df: DataFrame, validation_share: float, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Split whole input files into (train, validation) by a hash of the file path."""
    tagged = df.withColumn("_file", F.col("_metadata.file_path"))
    side = hash_fraction(["_file"], seed)
    return tagged.where(side >= validation_share).drop("_file"), tagged.where(side < validation_share).drop("_file")


def head_split(
    df: DataFrame, fraction: Column, test_share: float, train_share: float
) -> tuple[DataFrame, DataFrame]:
    """(test, train) taken from the front of a fixed shuffle order; they never overlap.

    ``fraction`` is the row's position in the shuffle order, scaled to [0,1).
    """
    test = df.where(fraction < test_share)
    train = df.where((fraction >= test_share) & (fraction < round(test_share + train_share, 12)))
    return test, train


def trim_nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.trim(F.col(column).cast("string"))).where(F.length(column) > 0)


def fill_unknown(df: DataFrame, columns: Sequence[str], value: int = -1) -> DataFrame:
    return df.na.fill(value, list(columns))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def dataset_profile(df: DataFrame, label: str, features: str) -> DataFrame:
    """rows, distinct labels, shortest and longest vector, and an empty flag, in one aggregation."""
    require_columns(df, [label, features])
    source = to_array(df, features).select(label, F.size(features).alias("_w"))
    return source.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(label).alias("n_labels"),
        F.min("_w").alias("min_width"),
        F.max("_w").alias("max_width"),
    ).withColumn("is_empty", F.col("n_rows") == 0)


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, non-empty values with their counts."""
    return trim_nonempty(df.select(column), column).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key under an explicit order (never an arbitrary one).

    The row limit is applied before the shuffle too, so a key holding very
    many copies does not reach one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_positional(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by position; differing widths are an error instead of a surprise."""
    for other in others:
        if len(other.columns) != len(first.columns):
            raise ValueError("positional union needs the same number of columns")
        first = first.union(other)
    return first


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def order_by_score(df: DataFrame, score: str, ties: Sequence[str]) -> DataFrame:
    """Best score first, missing scores last; equal ones by ``ties``.  A range sort over all partitions."""
    return df.orderBy(F.col(score).desc_nulls_last(), *ties)


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 11) -> DataFrame:
    """Reproducible shuffle: order by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), *keys)


def repartition_for_training(df: DataFrame, workers: int | None = None) -> DataFrame:
    """Even partitions kept in memory and on disk; the caller unpersists after training."""
    return (df.repartition(workers) if workers else df).persist()
