import itertools
import os

import numpy as np
import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rankloom.operators import factorization, ranker, request_blocks, training
from rankloom.operators.ranking_metrics import auc, ndcg_at_k
from rankloom.plans.jobs import JobPaths, run_job
from rankloom.session import SHUFFLE_REMOVAL_CONF, shared_root
from rankloom.sources.models import load_model, train_or_load


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    y = (rng.random(1500) < p).astype(float)
    rows = [(f"u{i % 20}", f"g{i % 7}", float(i % 4), float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["user_id", "goods_id", "kind", "label", "features"]).persist()


GBT = {"model": "lgb", "maxDepth": 3, "iterations": 8, "learningRate": 0.3}


@pytest.mark.parametrize(
    "cfg",
    [GBT, {**GBT, "model": "xgb", "trainTestRatio": 0.9, "autoScalePosRatio": 1}, {"model": "lr", "workers": 4},
     {"model": "fm", "factorSize": 2, "iterations": 60}],
)
def test_learners_beat_an_auc_floor(samples, cfg):
    scored = training.score(training.train(samples, cfg), samples)
    assert auc(scored, "prob", "label").first()[0] > 0.8


def test_regression_recovers_the_coefficients(samples):
    model = training.train(samples, {"model": "lr"})
    assert np.allclose(model.coefficients.toArray(), [2, -1, 0], atol=0.35)


@pytest.mark.parametrize(
    "bad", [{"lambda1": 0.5}, {"minSumHessionInLeaf": 5}, {"objective": "regression"}, {"boostingType": "dart"}, {"depthMax": 3}]
)
def test_settings_that_cannot_be_honoured_raise(samples, bad):
    with pytest.raises(ValueError):
        training.train(samples, {**GBT, **bad})


def test_unset_settings_are_ignored(samples):
    training.train(samples, {**GBT, "iterations": 1, "lambda1": "-", "weightCol": "", "leaves": 8})
    with pytest.raises(ValueError, match="not supported"):
        training.train(samples, {"model": "svm"})


# every key of the jobs' own configurations, with their defaults
LGB_FULL = {
    "model": "lgb", "featuresCol": "features", "labelCol": "label", "objective": "binary", "boostingType": "gbdt", "metric": "auc",
    "learningRate": 0.1, "maxDepth": -1, "trainingMetric": True, "barrierMode": False, "leaves": 31, "iterations": 3, "featureFraction": 1.0,
    "baggingFraction": 0.8, "baggingFreq": 0, "maxBin": 255, "isUnbalance": False, "minDataInLeaf": 20, "minSumHessionInLeaf": 1e-3,
    "lambda1": 0.0, "lambda2": 0.0, "categoricalSlotNames": "-", "weightCol": "-", "earlyStoppingRounds": 2, "workers": 4,
}
XGB_FULL = {
    "model": "xgb", "featuresCol": "features", "labelCol": "label", "objective": "binary:logistic", "metric": "auc", "trainTestRatio": 0.9,
    "learningRate": 0.1, "maxDepth": 4, "iterations": 3, "featureFraction": 1.0, "baggingFraction": 0.9, "treeMethod": "auto",
    "scalePosWeight": 1.0, "autoScalePosRatio": 0, "minChildWeight": 1, "alpha": 0.0, "lambda": 0.0, "gamma": 0.0,
    "categoricalSlotNames": "-", "weightCol": "-", "workers": 4,
}


@pytest.mark.parametrize("cfg", [LGB_FULL, XGB_FULL])
def test_whole_configurations_run(samples, cfg):
    scored = training.score(training.train(samples, cfg), samples)
    assert auc(scored, "prob", "label").first()[0] > 0.75


def test_whole_ranker_configuration_runs(samples):
    cfg = {**LGB_FULL, "model": "lgb_ranker", "objective": "lambdarank", "group": "user_id", "maxPosition": 5}
    del cfg["earlyStoppingRounds"]
    training.train(samples.select("user_id", "label", vector_to_array("features").alias("features")), cfg)


@pytest.mark.parametrize("depth, leaves, want", [(-1, 31, 5), (None, None, 5), (3, None, 3), (6, 8, 3), (2, 31, 2), (-1, 2, 1), (0, 33, 6)])
def test_tree_depth(depth, leaves, want):
    assert training.tree_depth(depth, leaves) == want


def test_grid_values_are_typed():
    grid = training.parameter_grid({"a": "1e-3,2", "b": "true,gbdt", "c": 5}, ["a", "b"])
    assert [g["a"] for g in grid] == [0.001, 0.001, 2, 2] and [g["b"] for g in grid] == [True, "gbdt", True, "gbdt"]


def test_job_preparation_marks_category_slots(spark):
    """40 shops, more than the default bins; membership and not order decides."""
    rows = [(float(c), -1.0 if i else 0.5, float(c % 7 in (1, 4)), Vectors.dense(0.0)) for c in range(40) for i in range(20)]
    df = spark.createDataFrame(rows, ["shop", "odd", "label", "features"])
    cfg = {"model": "lgb", "maxDepth": 1, "iterations": 1, "categoricalSlotNames": "shop,odd"}
    ready = training.prepare(df, cfg, add_category=True)
    assert training.categorical_sizes(ready, "features") == {0: 40}
    model = training.train(ready, cfg)
    assert auc(training.score(model, ready), "prob", "label").first()[0] == 1.0


def test_leaf_column_and_variants(samples):
    model = training.train(samples, {**GBT, "iterations": 2})
    row = training.score(model, samples, leaf_col="leaf").first()
    assert len(row["leaf"]) == 2
    named = training.score(model, samples).first()
    split = training.score(model, samples, variant="split").first()
    renamed = training.score(model, samples, variant="rename").first()
    assert named["prob"] == split["probability"] == renamed["probability"]
    assert split["prediction"] == named["predict"]
    assert renamed["rawPrediction"][1] == named["prob"]


def test_categorical_slots_are_used_as_categories(spark):
    # the label depends on membership, not on order
    rows = [(float(c in (1, 4)), Vectors.dense(float(c), 0.0)) for c in range(6) for _ in range(20)]
    df = spark.createDataFrame(rows, ["label", "features"])
    marked = training.mark_categorical(df, "features", {0: 6}, 2)
    model = training.train(marked, {"model": "lgb", "maxDepth": 1, "iterations": 1})
    assert "in {" in model.toDebugString
    assert auc(training.score(model, marked), "prob", "label").first()[0] == 1.0


def test_importance_and_tree_text(spark, samples):
    model = training.train(samples, GBT)
    fmap = spark.createDataFrame([(0, "strong"), (1, "weak")], "idx int, name string")
    for kind in ("gain", "split"):
        found = training.feature_importance(model, spark, kind, fmap).collect()
        assert found[0]["name"] == "strong"
    assert "strong" in training.dump_trees(model, {0: "strong"})


def test_grid_search_fits_every_combination_on_its_own(samples):
    cfg = {**GBT, "maxDepth": "1,4", "iterations": "1,10"}
    results, best_model, best = training.grid_search(samples, samples, cfg, ["maxDepth", "iterations"])
    rows = {r["params"]: r["test_auc"] for r in results.collect()}
    assert len(rows) == 4 and len(set(rows.values())) == 4
    assert (best["maxDepth"], best["iterations"]) == (4, 10)
    assert best_model.getNumTrees == 10


def test_saved_models_are_reused(spark, samples, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return training.train(samples, {"model": "lr"})

    path = f"{tmp_path}/m"
    first = train_or_load(spark, "lr", path, fit)
    second = train_or_load(spark, "lr", path, fit)
    assert len(calls) == 1 and first.coefficients == second.coefficients
    train_or_load(spark, "lr", path, fit, retrain=True)
    assert len(calls) == 2


def brute_pairs(rows, w, max_position):
    """Loss and gradient over every pair, one by one."""
    loss, grad = 0.0, np.zeros(len(w))
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        group = list(group)
        gains = sorted((2 ** r[1] - 1 for r in group), reverse=True)[:max_position]
        ideal = sum(g / np.log2(i + 2) for i, g in enumerate(gains))
        for a, b in itertools.permutations(group, 2):
            if a[1] > b[1]:
                weight = (2 ** a[1] - 2 ** b[1]) / ideal
                e = weight * np.exp(b[2] @ w - a[2] @ w)
                loss += e
                grad += e * (b[2] - a[2])
    return loss, grad


def test_ranker_loss_equals_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), float(y), rng.normal(size=2)) for g, y in zip(rng.integers(0, 6, 80), rng.integers(0, 4, 80))]
    df = spark.createDataFrame([(g, y, x.tolist()) for g, y, x in rows], "g int, label double, features array<double>")
    model = ranker.train_pairwise_ranker(df, "g", max_position=3, iterations=4, reg=0.0)
    scale = np.array(model.scales)
    z = [(g, y, (x - np.array(model.means)) / scale) for g, y, x in rows]
    assert model.losses[0] == pytest.approx(brute_pairs(z, np.zeros(2), 3)[0])
    assert model.losses[-1] == pytest.approx(brute_pairs(z, np.array(model.weights), 3)[0])
    # the first step follows the brute-force gradient
    direction = -brute_pairs(z, np.zeros(2), 3)[1]
    one = ranker.train_pairwise_ranker(df, "g", max_position=3, iterations=1, step=0.01, reg=0.0)
    assert np.allclose(np.array(one.weights), 0.01 * direction / np.linalg.norm(direction))


def test_ranker_improves_ndcg_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        for _ in range(8):
            y = int(rng.integers(0, 4))
            rows.append((g, float(y), [y + rng.normal() * 0.8, rng.normal() * 50]))
    df = spark.createDataFrame(rows, "g int, label double, features array<double>").persist()
    model = training.train(df, {"model": "lgb_ranker", "group": "g", "iterations": 6})
    after = ndcg_at_k(model.transform(df), "label", "prediction", 5, "g").agg(F.avg("ndcg")).first()[0]
    noise = ndcg_at_k(df.withColumn("prediction", F.col("features")[1]), "label", "prediction", 5, "g").agg(F.avg("ndcg")).first()[0]
    assert after > 0.85 > noise
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    model.save(f"{tmp_path}/r")
    assert load_model("lgb_ranker", f"{tmp_path}/r") == model


@pytest.mark.parametrize("kind", ["lr", "lgb", "lgb_ranker"])
def test_job_end_to_end(spark, samples, tmp_path, kind):
    samples.where("user_id <> 'u0'").write.parquet(f"{tmp_path}/data/train")
    samples.where("user_id = 'u0'").write.parquet(f"{tmp_path}/data/test")
    (tmp_path / "fmap.tsv").write_text("0\tfirst\n1\tsecond\n2\tthird\n")
    cfg = {"model": kind, "groupCols": "user_id,goods_id", "categoricalSlotNames": "kind", "iterations": 3}
    if kind == "lgb_ranker":
        cfg["group"] = "user_id"
    paths = JobPaths(f"{tmp_path}/data", "train", "test", f"{tmp_path}/model", f"{tmp_path}/out", f"{tmp_path}/fmap.tsv")
    report = run_job(spark, cfg, paths, add_category=True, explain=True)
    values = {(r["dataset"], r["grouping"]): r["value"] for r in report.collect()}
    assert set(values) == {(d, g) for d in ("train", "test") for g in ("all", "user_id", "goods_id")}
    assert values[("train", "all")] > 0.75
    assert "features" not in spark.read.parquet(f"{tmp_path}/out/predict/train").columns
    if kind == "lgb":
        assert spark.read.text(f"{tmp_path}/model-scores/gain").count() >= 1
    # without a training set the stored model is used
    again = run_job(spark, cfg, JobPaths(f"{tmp_path}/data", "-", "test", f"{tmp_path}/model", f"{tmp_path}/out2"), add_category=True)
    assert {r["dataset"] for r in again.collect()} == {"test"}


def test_training_takes_more_tasks_than_workers_for_many_rows(spark, monkeypatch):
    rows = spark.range(4_000).select(F.col("id").cast("double").alias("label"), array_to_vector(F.array(*[F.lit(1.0)] * 4)).alias("features"))
    assert training.training_parts(rows, 8, "features") == 8
    monkeypatch.setattr(training, "TRAINING_SHARE", 8_000)
    # 4,000 rows of 32 + 2 * 8 + 4 * 8 bytes
    assert training.training_parts(rows, 8, "features") == 40
    assert training.training_parts(rows.limit(0), 8, "features") == 8
    seen = []
    monkeypatch.setitem(training.TRAINERS, "lr", lambda df, cfg: seen.append(df.rdd.getNumPartitions()))
    training.train(rows, {"model": "lr", "workers": 8})
    assert seen == [40]


def test_ranker_sums_stay_in_hash_tables(spark, monkeypatch):
    plans = []
    first = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or first(df))
    rows = spark.createDataFrame([(g, float(g % 2 + i % 2), [float(i), float(g * i)]) for g in range(4) for i in range(4)], "g int, label double, features array<double>")
    ranker.train_pairwise_ranker(rows, "g", iterations=1)
    assert len(plans) == 3 and not any("ObjectHashAggregate" in p for p in plans[1:])


def test_ranker_steps_move_no_rows_and_leave_nothing(spark, monkeypatch):
    plans, kept = [], lambda: {p for p in os.listdir(shared_root(spark).removeprefix("file:")) if p.startswith("ranker")}
    first, before = type(spark.range(1)).first, kept()
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or first(df))
    rows = spark.range(400).selectExpr("id % 50 as g", "double(id % 3) as label", "array(double(id), double(id * id % 7)) as features")
    ranker.train_pairwise_ranker(rows, "g", iterations=2)
    assert len(plans) == 4 and not any("hashpartitioning" in p for p in plans)
    assert kept() == before and spark.conf.get(SHUFFLE_REMOVAL_CONF, None) is None


def test_ranker_packs_all_requests_but_the_large(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 300, 40, *rng.integers(1, 9, 60)]
    rows = [(g, float(rng.integers(0, 5)), rng.normal(size=2).tolist()) for g, n in enumerate(sizes) for _ in range(n)]
    rows += [(g, None, [float(g), 1.0]) for g in (0, 2, 7)] + [(None, 1.0, [9.0, 9.0])] + [(-1, y, [5.0, 1.0]) for y in (0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "g int, label double, features array<double>").repartition(3)
    monkeypatch.setattr(request_blocks, "BUCKETS", 4)
    found, total = request_blocks.large_requests(df.where("g is not null"), "g", 50, f"{tmp_path}/found")
    assert [r["g"] for r in found.collect()] == [2] and total == len(rows) - 1
    assert request_blocks.large_requests(df.where("g is not null"), "g", 1_000, f"{tmp_path}/none")[0] is None
    fit = lambda: ranker.train_pairwise_ranker(df, "g", max_position=3, iterations=5, step=0.3, reg=0.0)
    whole = fit()
    monkeypatch.setattr(request_blocks, "BLOCK_BYTES", 200)
    # all, some and no requests in blocks
    for most in (1_000, 50, 0):
        monkeypatch.setattr(ranker, "REQUEST_BYTES", 24 * most)
        model = fit()
        assert np.allclose(model.weights, whole.weights, atol=1e-12) and np.allclose(model.losses, whole.losses)
    assert len(whole.losses) > 2


@pytest.mark.parametrize("reg, iterations", [(0.0, 12), (0.01, 3), (0.0, 0)])
def test_packed_factorisation_equals_the_learner(spark, monkeypatch, reg, iterations):
    monkeypatch.setattr(factorization, "BLOCK_BYTES", 1_000)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    rows = [(float(a[0] + a[1] * a[2] > 0), Vectors.dense(a)) for a in x]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(3)
    learner = FMClassifier(factorSize=2, maxIter=iterations, stepSize=0.1, regParam=reg, seed=11)
    want, got = learner.fit(df), training.train(df, {"model": "fm", "factorSize": 2, "iterations": iterations, "learningRate": 0.1, "regParam": reg, "workers": 2})
    assert np.allclose(got.factors.toArray(), want.factors.toArray(), atol=1e-9)
    assert np.allclose(got.linear.toArray(), want.linear.toArray(), atol=1e-9) and got.intercept == pytest.approx(want.intercept, abs=1e-9)
    assert got.transform(df).columns == want.transform(df).columns
    # rows are stored as blocks, not one by one
    assert factorization.packed(df, "label", "features").count() <= 3 * 11
    for bad, said in ((df.withColumn("label", F.col("label") * 3), "labels must be 0 or 1"), (df.limit(0), "no rows")):
        with pytest.raises(Exception, match=said):
            training.train(bad, {"model": "fm", "workers": 2, "iterations": 1})
