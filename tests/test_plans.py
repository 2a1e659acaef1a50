"""Physical plans: what must hold at any data size."""

import os
import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators import behaviour, chunks, ranking_metrics as rm, samples, sizing
from rankloom.plans import catalog
from tests.conftest import SMALL

PYTHON_ALLOWED = {"top_items", "group_covariance", "stream_recent_sequence"}


def plan_of(df) -> str:
    """Operator tree (long lists may be shortened)."""
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df) -> str:
    """Operators with their full arguments."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


def test_auc_orders_only_range_totals_in_one_task(lineitem):
    plan = plan_of(rm.auc(lineitem, "l_extendedprice", "label", [1000.0, 1000.0, 5000.0]))
    # rows are ordered inside their range; the single-task window sees one row per range
    below = plan.split("Exchange SinglePartition", 1)[1]
    assert below.split("HashAggregate(keys=", 1)[1].startswith("[_chunk")
    windows = re.findall(r"specifiedwindowframe.*?\], \[(.*?)\]", plan)
    assert len(windows) == 2 and all("_chunk" in w for w in windows)
    assert plan.count("Exchange hashpartitioning") == 2  # value histogram, ranges


def test_auc_of_distinct_scores_moves_the_rows_once(lineitem):
    plan = plan_of(rm.auc(lineitem, "l_extendedprice", "label", [1000.0, 5000.0]))
    assert plan.count("Exchange hashpartitioning(_chunk") == 1 == plan.count("Exchange hashpartitioning")


def test_scans_read_only_needed_columns_and_push_time_filters(spark, lineitem):
    plan = plan_of(rm.group_auc(lineitem, "l_suppkey", "l_discount", "label", [0.05]))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_discount", "l_returnflag", "l_suppkey"]
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    asof = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    counters = details_of(behaviour.windowed_counts(events, ["user_id"], {"imp": "view", "buy": "purchase"}, asof))
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n?", counters).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "In(event_type" in pushed
    assert len(re.findall(r"\) Scan parquet", counters)) == 1 and counters.count("hashpartitioning") == 1


@pytest.mark.parametrize("build", ["dedup", "ndcg", "sequence"])
def test_group_limits_run_before_the_shuffle(spark, lineitem, build):
    if build == "dedup":
        df = samples.dedup(lineitem, ["l_suppkey"], ["l_partkey", "l_orderkey"])
    elif build == "ndcg":
        df = rm.ndcg_at_k(lineitem, "l_linenumber", "l_discount", 3, "l_suppkey")
    else:
        df = behaviour.behaviour_sequence(lineitem, ["l_suppkey"], "l_partkey", 5, [F.col("l_orderkey").desc()])
    plan = plan_of(df)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_numbering_has_no_unpartitioned_window_over_rows(lineitem):
    plan = plan_of(chunks.number_rows(lineitem.select("l_orderkey").distinct(), [F.col("l_orderkey")]))
    for exchange in re.findall(r"Exchange SinglePartition[\s\S]{0,400}", plan):
        assert "_part" in exchange


def test_downsampling_is_one_scan(lineitem):
    plan = plan_of(samples.stratified_downsample(lineitem, "label", 0.5, 0.5, "l_tax"))
    assert plan.count("FileScan") == 1 and "Union" not in plan and "Exchange" not in plan


def test_no_cartesian_products_and_no_row_python(spark):
    for name, build in catalog.QUERIES.items():
        if name.startswith(("stream_", "train_", "whitening_")) or name in (
            "run_job", "grid_search", "score_with_leaves", "positive_probability", "feature_importance", "save_and_load_model",
        ):
            continue
        plan = plan_of(build(spark, SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name
        if name not in PYTHON_ALLOWED:
            assert "InPandas" not in plan and "ArrowEvalPython" not in plan, name


def test_a_hot_group_is_split_into_ranges(spark):
    """A group with a third of all rows never gives one task much more than its share."""
    rows, parts = 12_000, 8
    df = spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
        (F.xxhash64("id") / F.lit(1e12)).alias("s"),
    )
    hist = chunks.value_histogram(df, ["g"], "s", [F.count(F.lit(1)).alias("c")], chunks.quantile_cuts(df, "s", parts))
    largest = hist.groupBy("g", chunks.CHUNK).agg(F.sum("c").alias("n")).agg(F.max("n")).first()[0]
    assert largest < 1.3 * rows / 3 / parts


def test_sizes_are_measured_before_a_broadcast(spark):
    small = spark.createDataFrame([(1, "abc", [1.0, 2.0])], "k int, t string, v array<double>")
    assert sizing.measured_bytes(small) == 32 + 8 + 12 + 16
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sizing.broadcast_if_small(small, 100))
    assert not hinted(sizing.broadcast_if_small(small, 50))
    assert sizing.measured_bytes(small.where("k = 2")) == 0


def test_annotation_files_are_bounded(spark, monkeypatch):
    from rankloom.plans import io_queries

    monkeypatch.setattr(io_queries, "RECORDS_PER_FILE", 1_000)
    found = catalog.QUERIES["read_object_annotations"](spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert len(found.inputFiles()) >= rows / 1_000 and found.agg(F.sum("n")).first()[0] == rows


def test_annotation_files_are_compressed(spark, tmp_path):
    lines = spark.range(3_000).selectExpr(
        "id div 3 as l_orderkey", "id % 200 as l_partkey", "id % 10 as l_suppkey", "int(id % 7 + 1) as l_linenumber",
        "double(id % 50 + 1) as l_quantity", "(id % 9) / 100D as l_tax", "substr('ANR', int(id % 3 + 1), 1) as l_returnflag",
    )
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["read_object_annotations"](spark, str(tmp_path))
    assert found.agg(F.sum("n")).first()[0] == 3_000
    # the text of an annotation has some 400 bytes
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in found.inputFiles()) < 80 * 3_000
