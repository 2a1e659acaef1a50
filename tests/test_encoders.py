import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rankloom.operators import chunks, encoders, joins, samples
from rankloom.sources.files import is_complete


def entries(dictionary):
    return {(r["column"], r["value"]): r["idx"] for r in dictionary.collect()}


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def test_most_frequent_value_is_zero_and_padding_is_trimmed(spark):
    df = frame(spark, [" b", "b ", "b", "a", "a", "z", "", "  ", None])
    assert entries(encoders.fit_dictionary(df, ["c"])) == {("c", "b"): 0, ("c", "a"): 1, ("c", "z"): 2}


def test_transform_trims_and_marks_unknown(spark):
    df = frame(spark, ["b", "b", "a"])
    model = encoders.FrequencyEncoder(["c"]).fit(df)
    got = model.transform(frame(spark, [" b ", "a", "new", None, ""]))
    assert [r[0] for r in got.collect()].count(-1) == 3
    assert sorted(r[0] for r in got.collect()) == [-1, -1, -1, 0, 1]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=30),
    st.lists(st.sampled_from("abcdefghijklmn"), min_size=1, max_size=30),
)
def test_extension_keeps_old_numbers(spark, old, new):
    first = encoders.fit_dictionary(frame(spark, old), ["c"])
    before = entries(first)
    after = entries(encoders.extend_dictionary(frame(spark, new), first, ["c"]))
    assert {k: after[k] for k in before} == before
    assert sorted(after.values()) == list(range(len(set(old) | set(new))))
    fresh = {v: new.count(v) for v in set(new) - set(old)}
    order = sorted(fresh, key=lambda v: (-fresh[v], v))
    assert [after[("c", v)] for v in order] == [len(set(old)) + i for i in range(len(order))]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_encoding_is_the_same_with_and_without_broadcast(spark, tmp_path, limit):
    df = spark.createDataFrame([("a", "p"), ("b", None), ("c", " q"), ("zz", "q")], "c string, d string")
    # stored first: fitting has hints of its own
    encoders.FrequencyEncoder(["c", "d"]).fit(df.where("c <> 'zz'")).save(f"{tmp_path}/d")
    known = encoders.FrequencyEncoder.load(spark, f"{tmp_path}/d", ["c", "d"]).dictionary
    plan = encoders.encode_columns(df, known, ["c", "d"], limit)
    hints = plan._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    assert hints == (2 if limit else 0)
    assert sorted(map(tuple, plan.collect())) == [(-1, 1), (0, 0), (1, -1), (2, 1)]


def test_fifty_columns_move_the_rows_twice(spark, tmp_path):
    names = [f"c{i}" for i in range(50)]
    rows = [(k, *[None if (k + i) % 7 == 0 else f" v{(k * i) % 5}" for i in range(50)], {"x": k}) for k in range(40)]
    df = spark.createDataFrame(rows, ", ".join(["key int", *[f"{n} string" for n in names], "rest map<string,int>"]))
    known = encoders.save_bucketed(encoders.fit_dictionary(df.where("key % 3 > 0"), names), "fifty_columns")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    dealt = encoders.encode_columns(df, known, names, 0)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "BroadcastExchange" not in plan
    want = {r["key"]: r.asDict(True) for r in encoders.encode_columns(df, known, names).collect()}
    assert {r["key"]: r.asDict(True) for r in dealt.collect()} == want and dealt.columns == df.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sql("DROP TABLE fifty_columns")


def test_one_large_column_moves_the_rows_once(spark):
    df = spark.createDataFrame([(k, None if k % 7 == 0 else f" v{k % 5}", {"x": k}) for k in range(40)], "key int, c string, rest map<string,int>")
    known = chunks.written_once(encoders.fit_dictionary(df.where("key % 5 > 0"), ["c"]), "one-column")
    dealt = encoders.encode_columns(df, known, ["c"], 0)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    # rows and entries by value, no regrouping by row; entries in a small file are not broadcast either
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan and "Aggregate" not in plan
    want = {r["key"]: r.asDict(True) for r in encoders.encode_columns(df, known, ["c"]).collect()}
    assert {r["key"]: r.asDict(True) for r in dealt.collect()} == want and dealt.columns == df.columns
    assert {r["c"] for r in want.values() if r["key"] % 7 == 0 or r["key"] % 5 == 0} == {-1}


def test_the_broadcast_budget_covers_all_columns_together():
    sizes = {f"c{i}": 10 * i for i in range(50)}
    chosen = encoders.within_budget(sizes, list(sizes), 100)
    assert chosen == ["c0", "c1", "c2", "c3", "c4"] and sum(sizes[c] for c in chosen) <= 100
    assert encoders.within_budget(sizes, list(sizes), 10**6) == sorted(sizes, key=lambda c: (sizes[c], c))


def test_first_extension_starts_at_zero_and_columns_are_independent(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "q")], "a string, b string")
    got = entries(encoders.extend_dictionary(df, None, ["a", "b"]))
    assert got == {("a", "x"): 0, ("a", "y"): 1, ("b", "q"): 0, ("b", "p"): 1}


def test_a_column_new_to_the_dictionary_starts_at_zero(spark):
    old = encoders.fit_dictionary(frame(spark, ["a"]), ["c"])
    df = spark.createDataFrame([("b", "k")], "c string, d string")
    assert entries(encoders.extend_dictionary(df, old, ["c", "d"])) == {("c", "a"): 0, ("c", "b"): 1, ("d", "k"): 0}


def test_numbering_many_rows_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).cast("string").alias("g"))
    got = chunks.number_rows(df, [F.col("v").desc()]).orderBy("idx").select("v").collect()
    assert [r[0] for r in got] == list(range(4999, -1, -1))
    grouped = chunks.number_rows(df, [F.col("v").asc()], within=["g"])
    bounds = grouped.groupBy("g").agg(F.min("idx"), F.max("idx"), F.count("*"), F.count_distinct("idx")).collect()
    assert all(r[1] == 0 and r[2] == r[3] - 1 and r[3] == r[4] for r in bounds)


def test_seen_and_unseen_cover_all_rows(spark):
    known = encoders.fit_dictionary(frame(spark, ["a", "b"]), ["c"])
    seen, unseen = encoders.split_seen_unseen(frame(spark, ["a", "x", None, " b"]), known, "c")
    assert (seen.count(), unseen.count()) == (2, 2)


def test_values_are_counted_before_they_are_looked_up(spark, monkeypatch):
    counts = encoders.value_counts(frame(spark, ["a", "x", None, "a", None]), "c")
    assert {r["c"]: r["n"] for r in counts.collect()} == {"a": 2, "x": 1, None: 2}
    known = chunks.written_once(encoders.fit_dictionary(frame(spark, ["a", "b"]), ["c"]), "known")
    monkeypatch.setattr(encoders, "BROADCAST_LIMIT", 0)
    seen, unseen = encoders.split_seen_unseen(counts, known, "c")
    assert [r["c"] for r in seen.collect()] == ["a"] and {r["c"]: r["n"] for r in unseen.collect()} == {"x": 1, None: 2}
    # values beyond the limit are sorted and merged, however small their file is
    assert all("SortMergeJoin" in p._jdf.queryExecution().executedPlan().toString() for p in (seen, unseen))


def test_save_and_load(spark, tmp_path):
    path = str(tmp_path / "dict")
    model = encoders.FrequencyEncoder(["c"]).fit(frame(spark, ["a", "b", "b"]))
    model.save(path)
    assert is_complete(spark, path)
    again = encoders.FrequencyEncoder.load(spark, path, ["c"])
    assert entries(again.dictionary) == entries(model.dictionary)


def test_unique_side_table_is_required(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.reattach(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).count() == 2
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="several rows for key"):
        joins.reattach(left, twice, ["k"]).collect()


def test_merged_text_keeps_its_width_with_nulls(spark):
    df = spark.createDataFrame([("i", 1, None, 3), ("j", None, None, None)], "k string, a int, b int, c int")
    got = dict(samples.drop_columns_merge(df, ["k"]).collect())
    assert got == {"i": "1,-1,3", "j": "-1,-1,-1"}


def test_downsampling_drops_other_labels(spark):
    rows = [(1.0, 0.5), (1.0, 0.95), (0.0, 0.1), (0.0, 0.3), (None, 0.0), (2.0, 0.0)]
    got = samples.stratified_downsample(spark.createDataFrame(rows, "y double, r double"), "y", 0.9, 0.2, "r")
    assert sorted(tuple(r) for r in got.collect()) == [(0.0, 0.1), (1.0, 0.5)]


@pytest.mark.parametrize("fold,share", [(1, 0.3), (5, 0.2)])
def test_key_split_is_disjoint_complete_and_stable(spark, fold, share):
    df = spark.range(4000).withColumnRenamed("id", "k")
    train, test = samples.split_train_test(df, fold, keys=["k"])
    again = samples.split_train_test(df.repartition(7), fold, keys=["k"])[1]
    assert train.count() + test.count() == 4000
    assert train.join(test, "k").count() == 0
    assert {r[0] for r in again.collect()} == {r[0] for r in test.collect()}
    assert abs(test.count() / 4000 - share) < 0.03


def test_positional_union_rejects_other_widths(spark):
    with pytest.raises(ValueError, match="same number of columns"):
        samples.union_positional(spark.range(1), spark.range(1).selectExpr("id", "id AS b"))


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nope"):
        encoders.encode_columns(frame(spark, ["a"]), encoders.fit_dictionary(frame(spark, ["a"]), ["c"]), ["nope"])
