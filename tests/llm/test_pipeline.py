import corpus_pipeline as cp
import __spark_entry__ as entry_points


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in entry_points.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in entry_points.queries()


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        if name != "mixing":
            assert after.count() <= docs.count() and after.exceptAll(docs).count() == 0, name
    placed = cp.STAGES[-1][1](spark, docs, small)
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == docs.count()


def test_odd_documents_pass_every_stage(spark, small, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, start, small)
            assert set(start.columns) <= set(out.columns), name
            out.count()


def test_run(spark, small):
    assert cp.run(spark, small).count() > 0
