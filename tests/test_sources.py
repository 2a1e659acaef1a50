from datetime import date

import pytest
from pyspark.sql import functions as F

from rankloom.operators import masks
from rankloom.session import scratch_path
from rankloom.sources import annotations, files, models, readers, writers


def test_missing_and_unset_datasets(spark, tmp_path):
    assert readers.read_dataset(spark, str(tmp_path), "-") is None
    with pytest.raises(FileNotFoundError, match="not exists!"):
        readers.read_dataset(spark, str(tmp_path), "absent")


def test_date_lists():
    assert readers.date_list("20240227", "20240301") == [date(2024, 2, 27), date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    assert readers.date_list("2024-01-01", "2024-01-06", step=2) == [date(2024, 1, 1), date(2024, 1, 3), date(2024, 1, 5)]
    assert len(readers.lookback_list("2024-01-31", 16)) == 17
    assert readers.dated_suffixes(["/a"], [date(2024, 1, 2)], "nested") == ["/a/2024/01/02"]


@pytest.mark.parametrize("layout", ["hive", "nested", "dash"])
def test_date_range_layouts(spark, tmp_path, layout):
    root = str(tmp_path)
    for d in range(1, 5):
        folder = date(2024, 1, d).strftime(readers.DAY_LAYOUTS[layout])
        spark.range(d).write.parquet(f"{root}/{folder}")
    df = readers.read_date_range(spark, root, "20240102", "20240103", with_date=True, layout=layout)
    assert dict(df.groupBy("_date").count().collect()) == {"20240102": 2, "20240103": 3}
    assert readers.read_date_range(spark, root, "20240102", "20240104", layout=layout).count() == 9
    with pytest.raises(FileNotFoundError):
        readers.read_date_range(spark, root, "20240104", "20240105", layout=layout)


def test_hive_range_opens_only_its_days(spark, tmp_path):
    spark.range(40).select("id", F.expr("date_add(DATE'2024-01-01', int(id % 4))").alias("dt")).write.partitionBy("dt").parquet(f"{tmp_path}/t")
    df = readers.read_date_range(spark, f"{tmp_path}/t", "20240102", "20240103")
    assert {f.split("dt=")[1][:10] for f in df.inputFiles()} == {"2024-01-02", "2024-01-03"}
    assert df.where("dt = DATE'2024-01-03'").count() == 10


def test_feature_map(spark, tmp_path):
    path = tmp_path / "fmap.tsv"
    path.write_text("3\t age \tq\n1\tprice\tq\n")
    assert dict(readers.read_feature_map(spark, str(path)).collect()) == {3: "age", 1: "price"}
    assert dict(readers.read_feature_map(spark, str(path), by_line=True).collect()) == {0: "age", 1: "price"}
    path.write_text("0\ta\n1\ta\n")
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_feature_map(spark, str(path))


def test_fixed_width_records(spark, tmp_path):
    path = f"{tmp_path}/r"
    spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, None)], "id int, a array<int>").write.parquet(path)
    good, bad = readers.read_fixed_width_records(spark, path, {"a": 2}, on_error="quarantine")
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]
    with pytest.raises(Exception, match="a needs 2 values"):
        readers.read_fixed_width_records(spark, path, {"a": 2}).collect()
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_fixed_width_records(spark, path, {"b": 2})


def test_part_files_only(spark, tmp_path):
    path = f"{tmp_path}/p"
    spark.range(5).coalesce(1).write.parquet(path)
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/q")
    source = next((tmp_path / "q").glob("part-*.parquet"))
    (tmp_path / "p" / "other.parquet").write_bytes(source.read_bytes())
    assert readers.read_part_files(spark, path).count() == 5
    assert spark.read.parquet(path).count() == 12


ANNOTATION = """<annotation><filename>{name}</filename><size><width>100</width><height>50</height></size>{objects}</annotation>"""
OBJECT = "<object><name>{n}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>"


def test_annotations(spark, tmp_path):
    two = OBJECT.format(n="dog", a="1.9", b="2", c="30", d="40") + OBJECT.format(n="cat", a="90", b="5", c="20", d="60")
    (tmp_path / "two.xml").write_text(ANNOTATION.format(name="two.jpg", objects=two))
    (tmp_path / "one.xml").write_text(ANNOTATION.format(name="one.jpg", objects=OBJECT.format(n="cow", a=0, b=0, c=10, d=10)))
    (tmp_path / "none.xml").write_text(ANNOTATION.format(name="none.jpg", objects=""))
    (tmp_path / "bad.xml").write_text("<annotation><filename>bad.jpg</filename><object><name>x</na")
    rows = annotations.read_object_annotations(spark, str(tmp_path))
    got = sorted((r["image"], r["category"], r["box_no"], r["xmin"], r["width"]) for r in rows.collect())
    assert got == [("one.jpg", "cow", 0, 0, 100), ("two.jpg", "cat", 1, 90, 100), ("two.jpg", "dog", 0, 1, 100)]
    (bad,) = annotations.unreadable_annotations(spark, str(tmp_path)).collect()
    assert bad["file"].endswith("bad.xml") and "bad.jpg" in bad["content"]
    scaled = {r["category"]: r for r in masks.normalize_boxes(rows).collect()}
    assert (scaled["cat"]["xmin_scaled"], scaled["cat"]["xmax_scaled"], scaled["cat"]["ymax_scaled"]) == (0.2, 0.9, 1.0)


def test_class_lists_and_multi_labels(spark, tmp_path):
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "dog_train.txt").write_text("a  1\nb -1\nc  0\n")
    (lists / "cat_train.txt").write_text("a  1\n")
    (lists / "cat_val.txt").write_text("z  1\n")
    got = sorted(tuple(r) for r in annotations.read_class_lists(spark, str(lists)).collect())
    assert got == [("train", "a", "cat"), ("train", "a", "dog"), ("val", "z", "cat")]
    (tmp_path / "multi.txt").write_text("a cat dog \nb cow\n\n")
    multi = annotations.read_multi_labels(spark, str(tmp_path / "multi.txt"))
    assert sorted((r["image"], r["labels"]) for r in multi.collect()) == [("a", ["cat", "dog"]), ("b", ["cow"])]
    assert annotations.read_multi_labels(spark, str(tmp_path / "multi.txt"), multi=True).count() == 1


def test_labelled_folders(spark, tmp_path):
    for c in ("bird", "sheep", "unknown"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "x.jpg").write_bytes(b"12")
    got = sorted((r["category"], r["label"]) for r in annotations.read_labelled_dirs(spark, str(tmp_path)).collect())
    assert got == [("bird", 0), ("sheep", 5)]


def test_half_written_tables_are_rebuilt(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert not files.is_complete(spark, path)
    assert writers.materialize_once(spark, path, lambda: spark.range(5)).count() == 5
    assert writers.materialize_once(spark, path, lambda: spark.range(9)).count() == 5


def test_predictions_are_stored_once(spark, tmp_path):
    path = f"{tmp_path}/p"
    df = spark.createDataFrame([(1, [1.0])], "id int, features array<double>")
    first = writers.predict_and_store(lambda d: d.withColumn("prob", F.lit(0.5)), df, path)
    assert first.columns == ["id", "prob"]
    assert writers.predict_and_store(lambda d: d.withColumn("prob", F.lit(0.9)), df, path).first()["prob"] == 0.5
    assert writers.predict_and_store(lambda d: d.withColumn("prob", F.lit(0.9)), df, path, repredict=True).first()["prob"] == 0.9


def test_prediction_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1, 0.123456789123)], "user_id int, goods_id int, label int, probability double")
    writers.write_predictions(df, f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/p")
    assert [f.dataType.simpleString() for f in back.schema] == ["string", "string", "float", "float"]
    with pytest.raises(ValueError, match="label"):
        writers.write_predictions(df.drop("label"), f"{tmp_path}/q")


def test_embedding_text_lines(spark, tmp_path):
    df = spark.createDataFrame([(7, [0.5, -1.25])], "id bigint, embedding array<float>")
    assert writers.embedding_lines(df).first()[0] == "7\t0.5,-1.25"
    for day in ("2024-01-01", "2024-01-02"):
        writers.export_embeddings(df, f"{tmp_path}/e", day)
    assert readers.read_embeddings_text(spark, f"{tmp_path}/e").count() == 2


def test_exported_partition_is_registered(spark, tmp_path):
    path = f"{tmp_path}/emb"
    spark.sql(f"CREATE TABLE emb_text (value STRING, dt STRING) USING text PARTITIONED BY (dt) LOCATION '{path}'")
    df = spark.createDataFrame([(7, [0.5])], "id bigint, embedding array<float>")
    writers.export_embeddings(df, path, "2024-01-05", table="emb_text")
    writers.export_embeddings(df, path, "2024-01-05", table="emb_text")
    assert [tuple(r) for r in spark.table("emb_text").collect()] == [("7\t0.5", "2024-01-05")]
    spark.sql("DROP TABLE emb_text")


def test_feature_scores_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "name string, score double")
    top = writers.write_feature_scores(df, f"{tmp_path}/s", shown=2)
    assert [r["name"] for r in top.collect()] == ["b", "c"]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/s").collect()) == ["a\t1.0", "b\t3.0", "c\t2.0"]


def test_unknown_model_types(spark, tmp_path):
    with pytest.raises(ValueError, match="not supported"):
        models.load_model("svm", str(tmp_path))


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
