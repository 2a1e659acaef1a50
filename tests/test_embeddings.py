import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import embeddings as emb, masks, predictions as pred, channels


@pytest.fixture(scope="module")
def table_rows():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    return base


@pytest.fixture(scope="module")
def vectors(spark, table_rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table_rows)], "id bigint, v array<double>").persist()


def test_covariance_matches_numpy(vectors, table_rows):
    got = np.zeros((2, 3, 3))
    for r in emb.group_covariance(vectors, "v", 3, epsilon=0.0).collect():
        got[r["grp"], r["i"], r["j"]] = r["cov"]
    full = np.cov(table_rows.T)
    assert np.allclose(got[0], full[:3, :3]) and np.allclose(got[1], full[3:, 3:])


@pytest.mark.parametrize("kind", emb.Whitening.KINDS)
def test_whitened_covariance_is_the_identity(vectors, kind):
    model = emb.Whitening.fit(vectors, "v", 3, kind, epsilon=1e-9, iterations=30)
    out = np.stack([r["w"] for r in model.transform(vectors, "v", "w").collect()])
    cov = np.cov(out.T)
    assert np.allclose(out.mean(axis=0), 0, atol=1e-6)
    assert np.allclose(cov[:3, :3], np.eye(3), atol=1e-4) and np.allclose(cov[3:, 3:], np.eye(3), atol=1e-4)


def test_whitening_settings_text():
    parsed = emb.Whitening.parse("0-1-16-zca-5-0")
    assert (parsed["m"], parsed["kind"], parsed["iterations"], parsed["affine"]) == (16, "zca", 5, False)
    with pytest.raises(ValueError, match="unknown whitening"):
        emb.Whitening.inverse_root(np.eye(2), "other")


def test_moving_statistics(spark):
    one = spark.createDataFrame([(0, 1.0), (1, 2.0)], "slot int, value double")
    two = spark.createDataFrame([(0, 3.0), (2, 9.0)], "slot int, value double")
    assert emb.moving_stats(None, one, ["slot"]) is one
    got = dict(emb.moving_stats(one, two, ["slot"], 0.9).collect())
    assert got == {0: pytest.approx(1.2), 1: 2.0, 2: 9.0}


def brute_top(users, items, k):
    out = {}
    for u, uv in users:
        scored = sorted(((float(np.dot(uv, iv)), i) for i, iv in items), key=lambda t: (-t[0], t[1]))
        out[u] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("cells", [None, (1000, 1000), (7, 5), (3, 100)])
def test_top_items_equals_brute_force_for_any_cell_size(spark, monkeypatch, cells):
    dealt = {} if cells is None else {"users_per_cell": cells[0], "items_per_cell": cells[1], "item_bytes": 0}
    monkeypatch.setattr(emb, "CELL_SCORES", 13)
    rng = np.random.default_rng(1)
    users = [(i, rng.integers(-2, 3, 4).astype(float)) for i in range(20)]
    items = [(100 + i, rng.integers(-2, 3, 4).astype(float)) for i in range(30)]
    u = spark.createDataFrame([(i, v.tolist()) for i, v in users], "user_id bigint, vec array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in items], "item_id bigint, vec array<double>")
    got = {}
    for r in emb.top_items(u, t, 4, **dealt).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got == brute_top(users, items, 4)


def test_blocks_that_cannot_beat_the_kth_score_are_skipped():
    rng = np.random.default_rng(9)
    items = rng.normal(size=(2000, 8)) * np.geomspace(10, 0.01, 2000)[:, None]
    users = np.concatenate([rng.normal(size=(50, 8)), np.zeros((1, 8))])
    blocks = emb.ItemBlocks.of(np.arange(2000), items, 64)
    row, ids, score, skipped = emb.best_of(users, blocks, 5)
    want = brute_top(list(enumerate(users)), list(enumerate(items)), 5)
    assert {u: ids[row == u].tolist() for u in range(51)} == want
    assert np.allclose(score, [users[u] @ items[i] for u, i in zip(row, ids)])
    # nearly all of 32 blocks fall away for every user but the one that scores 0 with all items
    assert len(blocks.bounds) == 32 and skipped > 50 * 20
    assert emb.best_of(users[:0], blocks, 5)[0].tolist() == []


def test_the_first_block_keeps_its_best_scores_only():
    rng = np.random.default_rng(4)
    items, users = rng.normal(size=(8_192, 8)), rng.normal(size=(200, 8))
    blocks = emb.ItemBlocks.of(np.arange(8_192), items)
    tracemalloc.start()
    row, ids, _, _ = emb.best_of(users, blocks, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = brute_top(list(enumerate(users)), list(enumerate(items)), 5)
    assert {u: ids[row == u].tolist() for u in range(200)} == want
    # the scores of a block, twice, and little else
    assert peak < 3 * 8 * 200 * emb.ITEM_BLOCK


def test_users_are_not_moved_and_empty_sides_have_no_rows(spark):
    schema = "{} bigint, vec array<double>"
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (1, [0.0, 1.0])], schema.format("user_id"))
    items = spark.createDataFrame([(7, [1.0, 2.0]), (8, None), (9, [3.0, 0.5])], schema.format("item_id"))
    found = emb.top_items(users, items, 1)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.user_id, r.item_id, r.score) for r in found.collect()) == [(1, 7, 2.0), (1, 9, 3.0)]
    assert emb.top_items(users, items.where("item_id = 8"), 3).collect() == []
    assert emb.top_items(users.where("user_id = 2"), items, 3).collect() == []


def test_pooling_ignores_padding_and_lookup_keeps_order(spark):
    table = spark.createDataFrame([(0, [9.0, 9.0]), (1, [1.0, 2.0]), (2, [10.0, 20.0])], "id bigint, vec array<double>")
    seq = spark.createDataFrame([("u", [2, 1, 2, 0, 0, 77])], "user string, ids array<bigint>")
    pooled = emb.sum_pool_sequence(seq, ["user"], "ids", table, "id", "vec").first()["pooled"]
    assert pooled == [21.0, 42.0]
    looked = emb.lookup_embeddings(seq, ["user"], "ids", table, "id", "vec").first()["vectors"]
    assert looked == [[10.0, 20.0], [1.0, 2.0], [10.0, 20.0], [9.0, 9.0], [9.0, 9.0], None]


def test_second_order_terms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>")
    f = df.select(emb.split_fields(F.col("v"), 3, 2).alias("f"))
    fm, mean = f.select(emb.fm_second_order(F.col("f"), 2), emb.pairwise_interaction(F.col("f"), 2)).first()
    assert fm == [1 * 3 + 1 * 5 + 3 * 5, 2 * 4 + 2 * 6 + 4 * 6]
    assert mean == [v / 3 for v in fm]


def test_iou_cases(spark):
    rows = [([1, 1, 0, 0], [0, 0, 1, 1], 0.0), ([1, 1, 0, 0], [1, 1, 0, 0], 1.0), ([1, 1, 0, 0], [0, 1, 1, 0], 1 / 3), ([0] * 4, [0] * 4, 0.0)]
    df = spark.createDataFrame(rows, "f array<int>, p array<int>, e double")
    assert all(abs(r["e"] - r["iou"]) < 1e-12 for r in df.withColumn("iou", masks.mask_iou(F.col("f"), F.col("p"))).collect())


def test_part_masks_fill_missing_parts(spark):
    rows = [(1, "bird", "head", [1, 0, 0, 0]), (1, "bird", "beak", [0, 1, 0, 0]), (1, "bird", "hoof", [1, 1, 1, 1]), (2, "cow", "tail", [1, 1, 1, 1])]
    got = {(r["image"], r["coarse"]): r["mask"] for r in masks.merge_part_masks(spark.createDataFrame(rows, "image int, category string, part string, mask array<int>")).collect()}
    assert got[(1, "head")] == [1, 1, 0, 0]
    assert got[(1, "torso")] == got[(1, "leg")] == got[(1, "tail")] == [0, 0, 0, 0]
    assert sorted(k[1] for k in got if k[0] == 2) == ["bleg", "fleg", "head", "torso"]


def test_packed_masks_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(n, rng.integers(0, 2, n).tolist(), rng.integers(0, 2, n).tolist()) for n in (0, 1, 63, 64, 65, 128, 200)]
    df = spark.createDataFrame(rows, "n int, f array<int>, p array<int>").withColumns({"a": masks.pack_mask(F.col("f")), "b": masks.pack_mask(F.col("p"))})
    merged = masks.unpack_mask(masks.merge_words(F.col("a"), F.col("b")), F.col("n"))
    for r in df.withColumns({"back": masks.unpack_mask(F.col("a"), F.col("n")), "both": merged, "iou": masks.packed_iou(F.col("a"), F.col("b"))}).collect():
        assert len(r.a) == -(-r.n // 64) and r.back == r.f
        assert r.both == [max(x, y) for x, y in zip(r.f, r.p)]
        inter, union = sum(x * y for x, y in zip(r.f, r.p)), sum(max(x, y) for x, y in zip(r.f, r.p))
        assert abs(r.iou - (inter / union if inter else 0)) < 1e-12


def test_part_masks_move_once_and_packed(spark):
    rows = [(1, "bird", "head", [1, 0]), (1, "bird", "beak", [0, 1, 1]), (1, "bird", "beak", [0, 1, 1]), (3, "cat", "hoof", [1])]
    df = spark.createDataFrame(rows, "image int, category string, part string, mask array<int>")
    merged = masks.merge_part_masks(df)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image") == 1 and "posexplode" not in plan
    got = {(r["image"], r["coarse"]): r["mask"] for r in merged.collect()}
    assert got[(1, "tail")] == [0, 0, 0] and got[(3, "head")] == [0] and len(got) == 4 + 5


def test_boxes(spark):
    rows = [(1, "dog", 0, 10, 0, 5, 50, 20, 20), (1, "dog", 1, 0, 0, 10, 10, 20, 20), (1, "dog", 2, 30, -4, 10, 4, 20, 20), (2, "cat", 0, 3, 3, 3, 9, 20, 20)]
    boxes = spark.createDataFrame(rows, "image int, category string, box_no int, xmin int, ymin int, xmax int, ymax int, width int, height int")
    largest = [tuple(r) for r in masks.largest_box(boxes).collect()]
    assert largest == [(1, "dog", 0, 0, 10, 10, 100)]  # reversed and flat boxes have no positive area
    scaled = {r["box_no"]: r for r in masks.normalize_boxes(boxes.where("image = 1")).collect()}
    assert (scaled[2]["xmin_scaled"], scaled[2]["xmax_scaled"], scaled[2]["ymin_scaled"]) == (0.5, 1.0, 0.0)
    assert [tuple(r) for r in masks.single_object_images(boxes).collect()] == [(2, "cat")]
    parts = spark.createDataFrame([(9, "cat")], "image int, category string")
    assert masks.single_object_images(boxes, parts).count() == 0


def test_labels_in_first_seen_order(spark):
    rows = [("train", "a", "dog", 3), ("train", "a", "cat", 1), ("train", "a", "dog", 0), ("valid", "a", "cow", 5)]
    got = {(r["split"], r["image"]): r["labels"] for r in masks.collect_labels(spark.createDataFrame(rows, "split string, image string, category string, pos int")).collect()}
    assert got == {("train", "a"): ["dog", "cat"], ("valid", "a"): ["cow"]}


def test_thresholds_match_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(c, float(v)) for c in range(3) for v in rng.normal(size=200)]
    df = spark.createDataFrame(rows, "channel int, value double")
    got = dict(channels.channel_thresholds(df, rate=0.05).collect())
    for c in range(3):
        assert got[c] == pytest.approx(np.percentile([v for k, v in rows if k == c], 95), abs=1e-12)


def test_belonging_takes_the_lowest_class_on_ties(spark):
    rows = [(1, 0, 0, 2.0), (2, 1, 0, 2.0), (1, 0, 1, 1.0), (2, 1, 1, 5.0)]
    df = spark.createDataFrame(rows, "image int, label int, channel int, value double")
    assert dict(channels.channel_class_belonging(df).collect()) == {0: 0, 1: 1}


def test_attack_metrics(spark):
    rows = [(0, [0.9, 0.1], [0.1, 0.9], 1), (0, [0.8, 0.2], [0.8, 0.2], 1), (1, [0.9, 0.1], [0.9, 0.1], 0), (1, [0.2, 0.8], [0.9, 0.1], 1)]
    df = spark.createDataFrame(rows, "label int, clean array<double>, adversarial array<double>, target int").withColumn("epsilon", F.lit(0.1))
    assert pred.keep_correct(df).count() == 3
    assert pred.attack_success_rate(df).first()["success_rate"] == pytest.approx(0.6667)
    assert pred.attack_success_rate(df, target="target").first()["success_rate"] == 0.5
    assert pred.attack_success_rate(df, only_correct=False).first()["success_rate"] == 0.75
    matrix = {(r["origin"], r["target"]): r["rate"] for r in pred.attack_target_matrix(df, [0, 1]).collect()}
    assert matrix == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1.0, (1, 1): 0.0}
    towards = {(r["origin"], r["target"]): r["rate"] for r in pred.attack_target_matrix(df, [0, 1], target="target").collect()}
    assert towards == {(0, 1): 0.5, (1, 1): 0.0}
    one_hot = df.withColumn("label", F.when(F.col("label") == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    assert pred.accuracy(one_hot, "clean", sparse=False).first()[0] == 0.75
