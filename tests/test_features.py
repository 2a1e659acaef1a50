import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg import Vectors as LegacyVectors
from pyspark.sql import functions as F

from rankloom.functions import arrays, scalars, vectors
from rankloom.operators import behaviour, features, samples
from rankloom.plans import contract
from rankloom.plans.contract import FeatureContract


def test_contract_width_and_strides():
    c = FeatureContract()
    assert c.strides == [150, 154, 174, 524, 719, 866, 890, 893, 921, 949, 983, 984]
    assert c.width == 984
    assert sum(w for _, w, _ in contract.SEQUENCE_SEGMENTS) == 350
    assert sum(w for _, w, _ in contract.REALTIME_PARTS) == 150


def test_contract_from_json():
    text = json.dumps(
        {
            "field_length_dict": {"a": 2, "b": 3},
            "dims_dict": {"g": {"x": 4, "y": 5}},
            "fmap": {"g": ["y", "x"]},
            "stride": {"inputs": ["b", "a"]},
        }
    )
    c = FeatureContract.from_json(text)
    assert c.fields == [("b", 3), ("a", 2)]
    assert c.group_dims("g") == [5, 4]


def test_elapsed_buckets_cover_0_to_113(spark):
    values = [0, 59, 60, 1439, 1440, 129600, 1e9, -5, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "m double")
    got = [r[0] for r in df.select(scalars.bucket_elapsed(F.col("m"))).collect()]
    assert got == [0, 0, 1, 23, 24, 113, 113, 0, None]


def test_buckets_and_clip_keep_null(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (7.0,), (1e12,)], "v double")
    row = df.select(
        scalars.clip(F.col("v"), 0.0, 5.0),
        scalars.bucket_equal_width(F.col("v")),
        scalars.bucket_log(F.col("v")),
        scalars.cap_count(F.col("v")),
    ).collect()
    assert [tuple(r) for r in row] == [(None,) * 4, (0.0, 0, 0, 0), (5.0, 1, 2, 2), (5.0, 5, 18, 2)]


def test_offset_ranges_are_disjoint(spark):
    dims = [3, 5, 2]
    df = spark.createDataFrame([([0, 0, 0],), ([2, 4, 1],), ([9, 9, 99],), ([-7, 0, 0],)], "ids array<bigint>")
    got = [r[0] for r in df.select(arrays.offset_encode(F.col("ids"), dims)).collect()]
    assert got == [[0, 3, 8], [2, 7, 9], [9, 9, 9], [0, 3, 8]]


def test_argmax_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "p array<double>")
    assert [r[0] for r in df.select(arrays.argmax(F.col("p"))).collect()] == [1, 0]


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([5, 0, -1],)], "s array<bigint>")
    row = df.select(
        arrays.sequence_mask(F.col("s")),
        arrays.sequence_mask(F.col("s"), strict_positive=False),
        arrays.valid_length(F.col("s")),
        arrays.pad_right(F.col("s"), 5),
        arrays.pad_right(F.col("s"), 2),
    ).first()
    assert list(row) == [[1, 0, 0], [1, 0, 1], 1, [5, 0, -1, 0, 0], [5, 0]]


def test_multi_hot_follows_the_vocabulary(spark):
    df = spark.createDataFrame([(["dog", "bird"],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(arrays.multi_hot(F.col("l"), ["bird", "cat", "dog"])).collect()] == [[1, 0, 1], [0, 0, 0]]


def test_minmax_of_a_constant_group_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 4.0)], "g string, v double")
    got = sorted((r["g"], r["v"]) for r in features.minmax_scale_by_group(df, ["g"], "v").collect())
    assert got == [("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]


def test_vector_conversions(spark):
    rows = [(Vectors.sparse(3, {1: 2.0}),), (Vectors.dense(1.0, 0.0, 4.0),)]
    dense = vectors.densify(spark.createDataFrame(rows, ["features"])).collect()
    assert [r[0].toArray().tolist() for r in dense] == [[0.0, 2.0, 0.0], [1.0, 0.0, 4.0]]
    legacy = spark.createDataFrame([(LegacyVectors.dense(1.0, 2.0),)], ["features"])
    assert vectors.to_ml_vector(legacy).first()[0] == Vectors.dense(1.0, 2.0)
    arrays_in = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    assert vectors.to_ml_vector(arrays_in).first()[0] == Vectors.dense(1.0, 2.0)
    with pytest.raises(TypeError, match="not a vector"):
        vectors.to_ml_vector(spark.createDataFrame([("x",)], "features string"))
    with pytest.raises(ValueError, match="missing columns"):
        vectors.to_ml_vector(spark.range(1))


def test_categories_come_first_and_unset_is_a_no_op(spark):
    df = spark.createDataFrame([(7, Vectors.dense(1.0, 2.0))], ["c", "features"])
    merged = samples.merge_category_features(df, "c").first()["features"]
    assert merged.toArray().tolist() == [7.0, 1.0, 2.0]
    for unset in (None, "", "-"):
        assert samples.merge_category_features(df, unset) is df
    flat = vectors.to_array(df)
    assert samples.merge_category_arrays(flat, "c", "features").first()["features"] == [7.0, 1.0, 2.0]


def test_excluded_slots_keep_the_length(spark):
    fmap = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, name string")
    df = spark.createDataFrame([(Vectors.dense(1.0, 2.0, 3.0),)], ["features"])
    out = samples.exclude_features(df, fmap, "b, unknown").first()[0]
    assert out == Vectors.dense(1.0, 0.0, 3.0)


def test_profile_reports_an_empty_set(spark):
    empty = spark.createDataFrame([], "label int, features array<double>")
    row = samples.dataset_profile(empty, "label", "features").first()
    assert (row["n_rows"], row["is_empty"]) == (0, True)


@pytest.mark.parametrize("exact", [True, False])
def test_quantile_buckets_are_balanced(spark, exact):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    got = behaviour.quantile_bucketize(df, "v", 4, exact=exact).groupBy("bucket").count().collect()
    assert sorted(r["bucket"] for r in got) == [0, 1, 2, 3]
    assert all(abs(r["count"] - 250) <= 5 for r in got)


def test_counters_respect_horizons_and_zero_bases(spark):
    rows = [("u", "view", "2024-01-30 12:00:00"), ("u", "click", "2024-01-30 13:00:00"), ("u", "view", "2024-01-28 00:00:00"),
            ("v", "click", "2024-01-29 23:59:59"), ("v", "click", "2024-01-31 00:00:00")]
    log = spark.createDataFrame(rows, "user string, event_type string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    asof = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    out = behaviour.windowed_counts(log, ["user"], {"imp": "view", "click": "click"}, asof, horizons=(1, 3))
    got = {r["user"]: r.asDict() for r in out.collect()}
    assert (got["u"]["imp_1d"], got["u"]["imp_3d"], got["u"]["click_rate_1d"], got["u"]["click_rate_3d"]) == (1, 2, 1.0, 0.5)
    assert (got["v"]["click_1d"], got["v"]["click_3d"], got["v"]["click_rate_3d"]) == (0, 1, 0.0)


def test_sequence_is_newest_first_and_padded(spark):
    df = spark.createDataFrame([("u", i, i * 10) for i in range(1, 6)], "u string, t int, item int")
    order = [F.col("t").desc()]
    assert behaviour.behaviour_sequence(df, ["u"], "item", 3, order).first()["sequence"] == [50, 40, 30]
    assert behaviour.behaviour_sequence(df, ["u"], "item", 7, order).first()["sequence"] == [50, 40, 30, 20, 10, 0, 0]


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "month"])
def test_gaps_do_not_depend_on_the_slice(spark, unit):
    rng = np.random.default_rng(3)
    minutes = sorted(rng.choice(60 * 24 * 5, 60, replace=False).tolist())
    df = spark.createDataFrame([("u", int(m)) for m in minutes], "u string, m int").select(
        "u", "m", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("m"))).alias("ts")
    )
    got = {r["m"]: r["gap"] for r in behaviour.gap_minutes(df, ["u"], slice_unit=unit).collect()}
    assert got == {m: (None if i == 0 else m - minutes[i - 1]) for i, m in enumerate(minutes)}
