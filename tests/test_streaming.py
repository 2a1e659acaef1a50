import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import behaviour as batch_behaviour, encoders
from rankloom.streaming import behaviour, learning
from rankloom.streaming.versions import VersionedTable

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, item bigint"


def write_batches(spark, root, batches):
    """One JSON file per micro-batch, in modification order."""
    import json
    import os
    import time

    os.makedirs(root, exist_ok=True)
    for i, rows in enumerate(batches):
        with open(f"{root}/{i}.json", "w") as f:
            for r in rows:
                f.write(json.dumps(dict(zip(["event_id", "ts", "user_id", "event_type", "item"], r))) + "\n")
        now = time.time() - 100 + i
        os.utime(f"{root}/{i}.json", (now, now))


def stream(spark, root):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(root)


BATCHES = [
    [(1, "2024-01-01 01:00:00", 1, "view", 10), (2, "2024-01-01 02:00:00", 1, "click", 11), (3, "2024-01-01 03:00:00", 2, "view", 10)],
    [(4, "2024-01-02 05:00:00", 1, "view", 12), (5, "2024-01-02 06:00:00", 2, "click", 13), (6, "2024-01-02 05:30:00", 1, "view", 14)],
    [(7, "2024-01-03 09:00:00", 1, "view", 15), (8, "2024-01-01 04:00:00", 2, "view", 99), (9, "2024-01-03 02:00:00", 3, "buy", 10)],
    [(10, "2024-01-01 05:00:00", 2, "view", 98), (11, "2024-01-03 10:00:00", 3, "view", 16)],
]


def all_rows(spark):
    rows = [r for b in BATCHES for r in b]
    df = spark.createDataFrame(rows, "event_id int, ts string, user_id int, event_type string, item int")
    return df.select(F.col("event_id").cast("bigint"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("bigint"), "event_type", F.col("item").cast("bigint"))


def test_counters_equal_the_batch_twin_on_closed_windows(spark, tmp_path):
    write_batches(spark, f"{tmp_path}/in", BATCHES)
    kinds = {"views": "view", "clicks": "click"}
    q = behaviour.stream_behaviour_counters(stream(spark, f"{tmp_path}/in"), ["user_id"], kinds, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    # event 8 arrives before its window is closed; event 10 arrives after that
    late = all_rows(spark).where("event_id = 10")
    twin = behaviour.behaviour_counters(all_rows(spark).exceptAll(late), ["user_id"], kinds)
    closed = twin.where("window_end <= TIMESTAMP'2024-01-03 09:00:00'")
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.select("window_start", "window_end", "user_id", *kinds).collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(closed)
    assert behaviour.late_rows(q) == 1


@pytest.mark.parametrize("fold_every", [0, 2])
def test_recent_sequence_equals_the_batch_twin(spark, tmp_path, fold_every):
    write_batches(spark, f"{tmp_path}/in", BATCHES)
    keys = ["user_id"]
    behaviour.stream_recent_sequence(stream(spark, f"{tmp_path}/in"), keys, "item", 3, f"{tmp_path}/s", f"{tmp_path}/ck", salts=2, fold_every=fold_every).awaitTermination()
    got = {r["user_id"]: r["sequence"] for r in behaviour.read_recent_sequence(spark, f"{tmp_path}/s", keys, 3).collect()}
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    twin = batch_behaviour.behaviour_sequence(all_rows(spark), keys, "item", 3, order)
    assert got == {r["user_id"]: r["sequence"] for r in twin.collect()}


@pytest.mark.parametrize("fold_every", [0, 2])
def test_passtime_equals_the_batch_twin(spark, tmp_path, fold_every):
    write_batches(spark, f"{tmp_path}/in", BATCHES)
    keys = ["user_id", "event_type"]
    asof = F.lit("2024-01-04 00:00:00").cast("timestamp")
    behaviour.stream_last_seen(stream(spark, f"{tmp_path}/in"), keys, f"{tmp_path}/s", f"{tmp_path}/ck", fold_every=fold_every).awaitTermination()
    got = behaviour.read_passtime(spark, f"{tmp_path}/s", keys, asof)
    twin = batch_behaviour.passtime(all_rows(spark), keys, asof)
    columns = [*keys, "minutes", "bucket"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, twin.select(columns).collect()))


@pytest.mark.parametrize("fold_every", [0, 1, 2])
def test_dictionary_grows_and_a_replay_changes_nothing(spark, tmp_path, fold_every):
    write_batches(spark, f"{tmp_path}/in", BATCHES)
    root = f"{tmp_path}/dict"
    learning.stream_extend_dictionary(stream(spark, f"{tmp_path}/in"), ["item"], root, f"{tmp_path}/ck", fold_every).awaitTermination()
    rows = all_rows(spark)
    expected = None
    for b in BATCHES:
        expected = encoders.extend_dictionary(rows.where(F.col("event_id").isin([r[0] for r in b])), expected, ["item"])
    entries = lambda df: sorted((r["column"], r["value"], r["idx"]) for r in df.collect())
    before = entries(learning.read_dictionary(spark, root))
    assert before == entries(expected)
    table = VersionedTable(spark, root)
    learning.extend_with_batch(rows.where("event_id in (4, 5, 6)"), 1, table, ["item"], fold_every)
    assert entries(learning.read_dictionary(spark, root)) == before


def test_streamed_regression_equals_batch_steps_and_survives_a_replay(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, root = rng.normal(size=(60, 2)), f"{tmp_path}/lr"
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    frames = [
        spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x[i : i + 20], y[i : i + 20])], "features array<double>, label double")
        for i in (0, 20, 40)
    ]
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={i}")
    source = spark.readStream.schema("features array<double>, label double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    learning.stream_train_lr(source, [0.1, 0.0], root, f"{tmp_path}/ck", intercept=0.2, steps=2, step=0.5).awaitTermination()
    table = VersionedTable(spark, root)
    assert table.versions() == [0, 1, 2]
    w, b = np.array([0.1, 0.0]), 0.2
    for i in range(0, 60, 20):
        xs, ys = x[i : i + 20], y[i : i + 20]
        for k in (1, 2):
            error = 1 / (1 + np.exp(-(xs @ w + b))) - ys
            w, b = w - 0.5 / np.sqrt(k) * xs.T @ error / 20, b - 0.5 / np.sqrt(k) * error.mean()
    row = table.latest().first()
    assert np.allclose(row["weights"], w) and row["intercept"] == pytest.approx(b)
    learning.train_with_batch(frames[2], 2, table, [0.1, 0.0], 0.2, "features", "label", 2, 0.5)
    assert np.allclose(table.latest().first()["weights"], w)


def test_moving_means_over_batches(spark, tmp_path):
    for i, v in enumerate((1.0, 2.0)):
        spark.createDataFrame([([v, 0.0],), ([v + 2, 4.0],)], "x array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    source = spark.readStream.schema("x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    learning.stream_moving_means(source, "x", f"{tmp_path}/m", f"{tmp_path}/ck", momentum=0.5).awaitTermination()
    got = dict(VersionedTable(spark, f"{tmp_path}/m").latest().select("slot", "value").collect())
    assert got == {0: 2.5, 1: 2.0}


def spread_tables(spark, small, root):
    """The small tables as folders of several files, some of them with no row of a slice of time."""
    spark.read.parquet(f"{small}/events.parquet").repartitionByRange(5, "ts").write.parquet(f"{root}/events.parquet")
    spark.read.parquet(f"{small}/embeddings.parquet").repartition(3, "vec_id").write.parquet(f"{root}/embeddings.parquet")
    return root


QUERIES_OF_FILES = ["stream_moving_means", "stream_passtime", "stream_passtime_buckets", "stream_recent_sequence", "stream_train_lr", "stream_late_rows"]


@pytest.mark.parametrize("name", QUERIES_OF_FILES)
def test_streams_do_not_depend_on_how_many_files_a_table_has(spark, small, tmp_path, name):
    from rankloom.plans import catalog

    root = spread_tables(spark, small, str(tmp_path))
    rows = lambda at: sorted(map(str, catalog.QUERIES[name](spark, at).collect()))
    assert rows(root) == rows(small)


@pytest.mark.parametrize("labels", [[], [1.0, 1.0], [0.0, 0.0]])
def test_gradient_of_no_rows_and_of_one_class(spark, labels):
    rows = spark.createDataFrame([([1.0, 2.0], y) for y in labels], "features array<double>, label double")
    gradient, bias, n = learning.logistic_gradient(rows, np.zeros(2), 0.0, "features", "label")
    error = 0.5 - labels[0] if labels else 0.0
    assert n == len(labels) and gradient == pytest.approx([error, 2 * error]) and bias == pytest.approx(error)


@pytest.mark.parametrize("fold_every", [0, 2])
def test_stored_buckets_follow_the_watermark_and_a_replay_changes_nothing(spark, tmp_path, fold_every):
    write_batches(spark, f"{tmp_path}/in", BATCHES)
    keys, root = ["user_id", "event_type"], f"{tmp_path}/s"
    behaviour.stream_passtime(stream(spark, f"{tmp_path}/in"), keys, root, f"{tmp_path}/ck", fold_every=fold_every).awaitTermination()
    mark = F.lit("2024-01-03 09:00:00").cast("timestamp")  # an hour behind event 11
    twin = batch_behaviour.passtime(all_rows(spark), keys, F.lit("2024-01-04 00:00:00").cast("timestamp")).select(*keys, "last_ts")
    minutes = batch_behaviour.elapsed_minutes(F.col("last_ts"), mark)
    expected = twin.select(*keys, F.unix_micros("last_ts"), batch_behaviour.bucket_elapsed(minutes))
    assert sorted(map(tuple, behaviour.read_buckets(spark, root, keys).collect())) == sorted(map(tuple, expected.collect()))
    again = behaviour.stream_passtime(stream(spark, f"{tmp_path}/in"), keys, root, f"{tmp_path}/ck2", fold_every=fold_every)
    again.awaitTermination()
    assert sorted(map(tuple, behaviour.read_buckets(spark, root, keys).collect())) == sorted(map(tuple, expected.collect()))


def test_expiring_sequences_keep_list_state(spark, tmp_path):
    write_batches(spark, f"{tmp_path}/in", BATCHES)
    args = (["user_id"], "item", 3, f"{tmp_path}/s", f"{tmp_path}/ck")
    behaviour.stream_recent_sequence(stream(spark, f"{tmp_path}/in"), *args, salts=2, expire_days=1.0).awaitTermination()
    got = {r["user_id"]: r["sequence"] for r in behaviour.read_recent_sequence(spark, f"{tmp_path}/s", ["user_id"], 3).collect()}
    # user 2 was last seen on 2024-01-02 06:00, more than a day before the last watermark
    assert 2 not in got and got[3][0] == 16
