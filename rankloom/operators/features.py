"""Slicing, clamping and encoding of the fixed-width model inputs.

Each function adds columns through one projection; nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.functions import arrays
from rankloom.functions.scalars import bucket_elapsed, bucket_equal_width, bucket_log, cap_count, clip
from rankloom.operators.sizing import broadcast_if_small
from rankloom.plans import contract as fixed
from rankloom.plans.contract import FeatureContract


def slice_features(df: DataFrame, vector: str, fields: Sequence[tuple[str, int]]) -> DataFrame:
    """Add one array column per named field, cut in order from the concatenated vector."""
    require_columns(df, [vector])
    return df.select("*", *arrays.field_slices(F.col(vector), fields))


def concat_features(df: DataFrame, columns: Sequence[str], out: str = "inputs") -> DataFrame:
    require_columns(df, columns)
    return df.withColumn(out, arrays.concat_as([F.col(c) for c in columns]))


def process_realtime(realtime: Column) -> list[Column]:
    """Bucketed realtime parts; each slot is moved into its own vocabulary range."""
    starts = dict(zip([n for n, _, _ in fixed.REALTIME_PARTS], arrays.offsets_of([w for _, w, _ in fixed.REALTIME_PARTS])))
    widths = {n: (w, v) for n, w, v in fixed.REALTIME_PARTS}

    def part(name: str, bucket) -> Column:
        width, vocabulary = widths[name]
        values = F.slice(realtime, starts[name] + 1, width)
        return arrays.offset_by_rule(F.transform(values, lambda v: bucket(v)), vocabulary).alias(name)

    return [
        cap_count(realtime[starts["realtime_pair_click"]]).alias("realtime_pair_click"),
        part("realtime_back_category", bucket_equal_width),
        part("realtime_goods", bucket_log),
        part("realtime_passtime", bucket_elapsed),
        part("realtime_user_group", lambda v: bucket_log(v, cap=129600.0)),
    ]


def process_context(context: Column, contract: FeatureContract | None = None) -> Column:
    """Week and hour, offset into one vocabulary; the third slot is not used and nothing is clamped."""
    dims = (contract or FeatureContract()).dims["others"]
    return arrays.offset_encode(F.slice(context, 1, 2), [dims["week"], dims["hour"]], clamp=False)


def select_sparse_ids(df: DataFrame, column: str, contract: FeatureContract | None = None) -> DataFrame:
    """Pick ids by name, clamp each to its vocabulary; eight are offset into ``goods_sparse``,
    three stay on their own."""
    contract = contract or FeatureContract()
    position = {n: i for i, n in enumerate(contract.names["goods_idx"])}
    sizes = contract.dims["others"]

    def pick(name: str, vocabulary: str) -> Column:
        return clip(F.col(column)[position[name]].cast("bigint"), 0, sizes[vocabulary] - 1)

    joined = F.array(*[pick(n, v) for n, v in fixed.SPARSE_CONCATENATED])
    sparse = arrays.offset_encode(joined, [sizes[v] for _, v in fixed.SPARSE_CONCATENATED])
    return df.select("*", sparse.alias("goods_sparse"), *[pick(n, v).alias(v) for n, v in fixed.SPARSE_SEPARATE])


def split_sequence(df: DataFrame, column: str, contract: FeatureContract | None = None) -> DataFrame:
    """Twelve of the fourteen behaviour segments, each clamped to its vocabulary."""
    sizes = (contract or FeatureContract()).dims["others"]
    starts = arrays.offsets_of([w for _, w, _ in fixed.SEQUENCE_SEGMENTS])
    parts = [
        arrays.clip_all(F.slice(F.col(column), s + 1, w).cast("array<bigint>"), 0, sizes[v] - 1).alias(n)
        for s, (n, w, v) in zip(starts, fixed.SEQUENCE_SEGMENTS)
        if v is not None
    ]
    return df.select("*", *parts)


def process_bucket_group(values: Column, dims: Sequence[int], keep: Sequence[tuple[int, int]] = ()) -> Column:
    """Discrete slots of a bucket field, offset encoded and clamped to the shared vocabulary.

    ``keep`` lists (start, width) ranges of the field that hold discrete slots.
    """
    ids = F.concat(*[F.slice(values, s + 1, w) for s, w in keep]) if keep else values
    return arrays.offset_encode(ids.cast("array<bigint>"), dims)


def continuous_slots(values: Column, start: int, width: int) -> Column:
    """Continuous slots of a bucket field, clamped to [0, 1]."""
    return arrays.clip_all(F.slice(values, start + 1, width).cast("array<double>"), 0.0, 1.0)


def process_pair(pair: Column, contract: FeatureContract | None = None) -> Column:
    """The four pair slots, clamped to their shared vocabulary without offsets."""
    dims = (contract or FeatureContract()).dims["others"]
    total = sum(dims[n] for n in fixed.PAIR_NAMES)
    return arrays.clip_all(pair.cast("array<bigint>"), 0, total - 1)


def process_inputs(df: DataFrame, inputs: str, contract: FeatureContract) -> DataFrame:
    """All model inputs from the concatenated vector, in one projection.

    The contract must list the vocabularies of the bucket groups (its JSON
    form does).  Outputs: the realtime parts, ``context``, ``goods_sparse`` and
    the separate ids, the twelve sequence segments, ``pair``, and per bucket
    field ``<field>_obj`` (discrete) and ``<field>_raw`` (continuous).
    """
    fields = {n: c for (n, _), c in zip(contract.fields, arrays.field_slices(F.col(inputs), contract.fields))}
    widths = dict(contract.fields)
    columns = process_realtime(fields["realtime_features"])
    columns.append(process_context(fields["context_feature"].cast("array<bigint>"), contract).alias("context"))
    columns.append(process_pair(fields["features_pair_4"], contract).alias("pair"))
    for name, slots in fixed.BUCKET_SLOTS.items():
        group = name.removesuffix("_features")
        columns.append(process_bucket_group(fields[name], contract.group_dims(group), slots).alias(f"{group}_obj"))
        start = fixed.CONTINUOUS_START.get(name)
        if start is not None:
            columns.append(continuous_slots(fields[name], start, widths[name] - start).alias(f"{group}_raw"))
    kept = [c for c in df.columns if c != inputs]
    wide = df.select(
        *kept, *columns, fields["goods_sparse_features"].alias("_ids"), fields["sequence"].alias("_sequence")
    )
    return split_sequence(select_sparse_ids(wide, "_ids", contract), "_sequence", contract).drop("_ids", "_sequence")


def clip_columns(df: DataFrame, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    require_columns(df, columns)
    return df.withColumns({c: clip(F.col(c), lo, hi) for c in columns})


def minmax_scale_by_group(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """(v - min) / (max - min) within each group; a constant group gives 0.

    The two extremes are aggregated first (combining before the shuffle) and
    joined back, so a huge group never has to sit in one window task.  NULL is
    a key like any other.
    """
    v = F.col(value).cast("double")
    bounds = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (v - F.col("_lo")) / span).when(v.isNotNull(), F.lit(0.0))
    names = [f"_k{i}" for i in range(len(keys))]
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    joined = df.join(broadcast_if_small(bounds.toDF(*names, "_lo", "_hi")), same)
    return joined.withColumn(out or value, scaled).drop("_lo", "_hi", *names)


