import bisect
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from rankloom.operators import chunks, losses, ranking_metrics as rm


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(g), float(s), int(y))
        for g, s, y in zip(
            rng.choice([0, 0, 0, 1, 2, 3], 400), rng.integers(0, 25, 400) / 10, rng.integers(0, 2, 400)
        )
    ]
    rows += [(9, 0.5, 1), (9, 0.7, 1)]  # one class only
    return rows, spark.createDataFrame(rows, "g int, s double, y int").persist()


def test_auc_equals_pair_counting(scored):
    rows, df = scored
    assert rm.auc(df, "s", "y").first()[0] == pytest.approx(brute_auc([(s, y) for _, s, y in rows]), abs=1e-12)


@pytest.mark.parametrize("cuts", [[], [1.0], [1.0, 1.0, 2.0], [0.1 * i for i in range(25)], [-5.0, 99.0], [0.5, 1.5]])
def test_cut_points_never_change_the_result(scored, cuts):
    _, df = scored
    assert rm.auc(df, "s", "y", cuts).first()[0] == pytest.approx(rm.auc(df, "s", "y").first()[0], abs=1e-12)
    a = rm.group_auc(df, "g", "s", "y", cuts).first()
    b = rm.group_auc(df, "g", "s", "y").first()
    assert a["group_auc"] == pytest.approx(b["group_auc"], abs=1e-12)


def test_group_auc_equals_pair_counting(scored):
    rows, df = scored
    by = {}
    for g, s, y in rows:
        by.setdefault(g, []).append((s, y))
    kept = {g: p for g, p in by.items() if len({y for _, y in p}) == 2}
    total = sum(len(p) for p in kept.values())
    expected = sum(brute_auc(p) * len(p) / total for p in kept.values())
    row = rm.group_auc(df, "g", "s", "y").first()
    assert row["group_auc"] == pytest.approx(expected, abs=1e-12)
    assert (row["groups"], row["rows_used"], row["rows_unscored"]) == (len(kept), total, 0)


@pytest.mark.parametrize("cuts", [None, [], [0.0, 0.25, 0.5]])
def test_null_scores_are_counted_and_null_groups_left_out(spark, cuts):
    rows = [(1, 0.1, 0), (1, 0.9, 1), (1, None, 1), (None, 0.3, 1), (None, 0.2, 0)]
    row = rm.group_auc(spark.createDataFrame(rows, "g int, s double, y int"), "g", "s", "y", cuts).first()
    assert (row["group_auc"], row["groups"], row["rows_used"], row["rows_unscored"]) == (1.0, 1, 2, 1)


@pytest.mark.parametrize("cuts", [[], [0.2, 0.6]])
def test_nan_ranks_above_every_number(spark, cuts):
    nan = float("nan")
    df = spark.createDataFrame([(0.1, 0), (nan, 1), (nan, 0), (0.9, 1)], "s double, y int")
    assert rm.auc(df, "s", "y", cuts).first()[0] == (1 + 0.5 + 1 + 0) / 4


def test_many_nans_count_as_a_heavy_value(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 1.0).alias("s"))
    assert chunks.has_heavy_values(chunks.quantile_cuts(df, "s", 8))
    assert not chunks.has_heavy_values(chunks.quantile_cuts(df.where(~F.isnan("s")), "s", 8))


def test_labels_other_than_0_and_1_do_not_count(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 2), (0.5, None), (0.9, 1)], "s double, y int")
    assert rm.auc(df, "s", "y", []).first()[0] == rm.auc(df, "s", "y", [0.2, 0.6]).first()[0] == 1.0


def test_auc_symmetry_and_monotone_maps(scored):
    _, df = scored
    value = rm.auc(df, "s", "y").first()[0]
    assert rm.auc(df.withColumn("s", -F.col("s")), "s", "y").first()[0] == pytest.approx(1 - value, abs=1e-12)
    assert rm.auc(df.withColumn("s", F.exp("s") * 3), "s", "y").first()[0] == pytest.approx(value, abs=1e-12)


def test_one_group_equals_overall(scored):
    _, df = scored
    one = df.withColumn("g", F.lit("x"))
    assert rm.group_auc(one, "g", "s", "y").first()["group_auc"] == pytest.approx(rm.auc(df, "s", "y").first()[0])


def test_auc_agrees_with_the_ml_evaluator(spark, small):
    rows = spark.read.parquet(f"{small}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("s"), (F.col("l_returnflag") == "R").cast("double").alias("y")
    )
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert rm.auc(rows, "s", "y").first()[0] == pytest.approx(evaluator.evaluate(rows), abs=1e-9)


def test_auc_of_one_class_is_null(spark):
    assert rm.auc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int"), "s", "y").first()[0] is None


def test_batch_mean_skips_one_class_batches(spark):
    rows = [(1, 0.1, 0), (1, 0.9, 1), (2, 0.9, 0), (2, 0.1, 1), (3, 0.5, 1)]
    row = rm.batch_mean_auc(spark.createDataFrame(rows, "b int, s double, y int"), "b", "s", "y").first()
    assert (row["mean_auc"], row["batches"]) == (0.5, 2)


def test_rank_in_group_averages_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "g string, s double")
    ranks = sorted((r["g"], r["s"], r["avg_rank"]) for r in rm.rank_in_group(df, "g", "s").collect())
    assert ranks == [("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 3.0, 4.0), ("b", 5.0, 1.0)]


@pytest.mark.parametrize("probabilities", [[0.0, 0.25, 0.5, 0.9, 1.0]])
def test_exact_quantiles_match_numpy(scored, probabilities):
    rows, df = scored
    found = {(r["g"], r["p"]): r["value"] for r in chunks.exact_quantiles(df, "s", probabilities, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [s for k, s, _ in rows if k == g]
        for p in probabilities:
            assert found[(g, p)] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_positions_match_a_sorted_list(scored):
    rows, df = scored
    numbered = df.withColumn("k", F.monotonically_increasing_id()).persist()
    expected = {}
    for r in sorted(numbered.collect(), key=lambda r: (r["g"], -r["s"], r["k"])):
        expected.setdefault(r["g"], []).append(r["k"])
    for r in rm.position_in_group(numbered, "g", "s", ["k"]).collect():
        assert expected[r["g"]][r["position"] - 1] == r["k"]


def test_topk_keeps_k_as_denominator(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "s double, y int")
    row = rm.topk_metrics(df, "s", "y", [2, 10]).orderBy("k").collect()
    assert (row[0]["tp"], row[0]["precision"], row[0]["recall"], row[0]["f1"]) == (1.0, 0.5, 0.5, 0.5)
    assert (row[1]["tp"], row[1]["precision"], row[1]["recall"]) == (2.0, 0.2, 1.0)


def test_topk_without_positives(spark):
    row = rm.topk_metrics(spark.createDataFrame([(0.9, 0)], "s double, y int"), "s", "y", [1]).first()
    assert (row["tp"], row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, None, 0.0)


def test_ndcg_small_case_and_zero_ideal(spark):
    df = spark.createDataFrame([("a", 3, 0.1), ("a", 0, 0.9), ("a", 1, 0.5), ("b", 0, 0.2)], "r string, y int, s double")
    got = {r["r"]: r["ndcg"] for r in rm.ndcg_at_k(df, "y", "s", 3, "r").collect()}
    dcg = 0 / 1 + 1 / math.log2(3) + 7 / 2
    ideal = 7 + 1 / math.log2(3)
    assert got["a"] == pytest.approx(dcg / ideal)
    assert got["b"] == 0.0
    assert rm.ndcg_at_k(df.where("r = 'a'"), "y", "s", 10).first()[0] == pytest.approx(dcg / ideal)


def test_scale_pos_weight_rules(spark):
    df = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 8, "label double")
    weight = lambda **kw: rm.scale_pos_weight(df, **kw).first()["weight"]
    assert weight(explicit=3.0) == 3.0
    assert weight() == 1.0
    assert weight(auto_ratio=2) == 2.0
    flipped = df.withColumn("label", 1 - F.col("label"))
    assert rm.scale_pos_weight(flipped, auto_ratio=2).first()["weight"] == 1.0
    with pytest.raises(Exception, match="no positive rows"):
        rm.scale_pos_weight(df.where("label = 0"), auto_ratio=2).collect()


def test_spread_margin_schedule():
    assert losses.spread_margin(0) == pytest.approx(0.2 + 0.79 / (1 + math.exp(4)))
    assert losses.spread_margin(10**9) == pytest.approx(0.2 + 0.79 / (1 + math.exp(-10)))


def test_entropy_of_known_distributions(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0, 0.0],)], "p array<double>")
    row = losses.distribution_entropy(df, "p").first()
    assert row["mean_entropy"] == pytest.approx(math.log(2) / 2)
    assert row["std_entropy"] == pytest.approx(math.log(2) / 2)


def test_compare_predictions_reports_coverage(spark):
    old = spark.createDataFrame([(1, "u", 0.1, 0), (2, "u", 0.9, 1), (3, "u", 0.5, 1)], "k int, u string, probability double, label int")
    new = spark.createDataFrame([(1, "u", 0.9, 0), (2, "u", 0.1, 1), (4, "u", 0.5, 1)], "k int, u string, probability double, label int")
    row = rm.compare_predictions(old, new, ["k"], "u").first()
    assert (row["in_both"], row["only_old"], row["only_new"]) == (2, 1, 1)
    assert (row["old_auc"], row["new_auc"]) == (1.0, 0.0)


def test_cuts_weigh_input_tasks_by_their_rows(spark):
    """One large and seven tiny input tasks: no range takes more than twice its share."""
    big = spark.range(0, 200_000, 1, 1).select((F.col("id") * 7919 % 200_003).cast("double").alias("s"))
    tiny = spark.range(0, 700, 1, 7).select((F.col("id") / 1e6 - 1).alias("s"))
    df = big.union(tiny)
    sizes = chunks.with_chunk(df, "s", chunks.quantile_cuts(df, "s", 8)).groupBy(chunks.CHUNK).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) <= 2 * 200_700 / 8


def test_only_hot_groups_are_cut(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5_000).alias("g"),
        (F.col("id") * 31 % 977 / 977.0).alias("s"),
        (F.col("id") * 17 % 5 < 2).cast("int").alias("y"),
    )
    assert chunks.hot_groups(df, ["g"], 8) == [(-1,)]
    got = {r["g"]: r["auc"] for r in rm.auc_by_group(df, "g", "s", "y").collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["g"], []).append((r["s"], r["y"]))
    for g in (-1, 1, 7, 4_999):
        pos = [s for s, y in rows[g] if y]
        neg = sorted(s for s, y in rows[g] if not y)
        if pos and neg:
            won = sum(bisect.bisect_left(neg, s) + bisect.bisect_right(neg, s) for s in pos) / 2
            assert abs(got[g] - won / (len(pos) * len(neg))) < 1e-12


def test_tied_hot_group_keeps_positions(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.lit(0.5).alias("s"), (F.col("id") * 7 % 20_000).alias("k"))
    got = rm.position_in_group(df, "g", "s", ["k"])
    assert got.where("position <> k + 1").count() == 0 and got.count() == 20_000
    ranks = rm.rank_in_group(df.withColumn("g", F.nullif("g", F.lit("a"))), "g", "s").agg(F.min("avg_rank"), F.max("avg_rank"), F.count("g")).first()
    assert tuple(ranks) == (10_000.5, 10_000.5, 0)
