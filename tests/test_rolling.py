"""Counts that move by a day, and stored sketches."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.operators import sketches
from rankloom.operators.daily_counts import RollingCounts, day_counts

KINDS = {"imp": "view", "buy": "purchase"}


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet")


def recounted(events, day, horizons):
    end = F.lit(f"{day + timedelta(days=1)} 00:00:00").cast("timestamp_ntz")
    counts = [
        F.count_if((F.col("event_type") == v) & (F.col("ts") >= end - F.make_interval(days=F.lit(h)))).alias(f"{n}_{h}d") for h in horizons for n, v in KINDS.items()
    ]
    out = events.where(F.col("ts") < end).groupBy("user_id").agg(*counts)
    return sorted(map(tuple, out.where(f"imp_{horizons[-1]}d + buy_{horizons[-1]}d > 0").collect()))


def test_rolled_days_equal_the_full_count(spark, events, tmp_path):
    counts = RollingCounts(spark, f"{tmp_path}/r", ["user_id"], KINDS, [1, 3, 5])
    first = date(2024, 1, 4)
    counts.count_day(events, first)
    counts.rebuild(first)
    for k in range(1, 8):
        day = first + timedelta(days=k)
        got = counts.roll(events.where(F.to_date("ts") >= F.lit(str(first))), day)
        assert sorted(map(tuple, got.select("user_id", *counts.names()).collect())) == recounted(events.where(F.to_date("ts") >= F.lit(str(first))), day, [1, 3, 5])


def test_a_finished_day_is_not_made_again_and_a_lost_one_is(spark, events, tmp_path):
    counts = RollingCounts(spark, f"{tmp_path}/r", ["user_id"], KINDS, [1, 3])
    days = [date(2024, 1, 10) + timedelta(days=k) for k in range(3)]
    for day in days[:2]:
        counts.count_day(events, day)
    counts.rebuild(days[1])
    once = sorted(map(tuple, counts.roll(events, days[2]).collect()))
    assert sorted(map(tuple, counts.roll(events.limit(0), days[2]).collect())) == once
    # without yesterday's table the stored partial counts give the same
    other = RollingCounts(spark, f"{tmp_path}/o", ["user_id"], KINDS, [1, 3])
    for day in days[:2]:
        other.count_day(events, day)
    assert sorted(map(tuple, other.roll(events, days[2]).collect())) == once
    with pytest.raises(ValueError):
        RollingCounts(spark, f"{tmp_path}/n", ["user_id"], KINDS).rebuild(days[0])


def test_one_day_is_read(events):
    plan = day_counts(events, ["user_id"], KINDS, date(2024, 1, 10))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_sketches_merge_to_those_of_all_rows(spark):
    rows = spark.range(20_000).select(
        (F.col("id") % 7).alias("day"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 5_000).alias("x").cast("double"),
        F.lit(None).cast("double").alias("none"),
        F.concat(F.lit("k"), (F.col("id") % 321).cast("string")).alias("name"),
    )
    merged = sketches.merge_sketches(sketches.sketch_columns(rows, ["day"], ["x", "none"], ["name"])).collect()
    found = {r["column"]: r for r in merged}
    assert (found["x"]["n"], found["x"]["missing"], found["none"]["n"], found["none"]["missing"]) == (18_000, 2_000, 0, 20_000)
    again = sketches.merge_sketches(sketches.sketch_columns(rows, ["day"], ["x", "none"], ["name"]))
    values = {(r["column"], r["p"]): r["value"] for r in sketches.sketched_quantiles(again, [0.1, 0.5, 0.9]).collect()}
    assert set(values) == {("x", 0.1), ("x", 0.5), ("x", 0.9)}
    low, high = rows.agg(*sketches.rank_between(F.col("x"), F.lit(values["x", 0.5]))).first()
    assert low - sketches.RANK_ERROR <= 0.5 <= high + sketches.RANK_ERROR
    distinct = {r["column"]: r["distinct_values"] for r in sketches.sketched_distinct(again).collect()}
    assert abs(distinct["name"] - 321) <= 17 and distinct["none"] == 0
    none = sketches.merge_sketches(sketches.sketch_columns(rows.where("false"), ["day"], ["x"], []))
    assert none.collect() == []
