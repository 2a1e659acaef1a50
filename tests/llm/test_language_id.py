import pytest
from pyspark.sql import functions as F

from rankloom.llm.language_id import declared_in, identify, keep_identified

DE = "der hund und die katze schlafen nicht auf dem warmen ofen im winter "
EN = "the dog and the cat sleep on that warm stove in the winter with us "


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "de" if i % 2 else "en-US", f"h{i % 4}.example.{'de' if i % 2 else 'com'}", (DE if i % 2 else EN)[i % 9 :] * 3) for i in range(40)]
    data += [(100, "en", "h1.example.de", DE * 5), (101, None, "new.example.de", "ofen"), (102, None, None, ""), (103, "de", None, None), (104, "?", "x", "123 456")]
    data += [(105, None, "h1.example.de", DE), (105, None, "h1.example.de", DE), (106, "en", "a", EN * 3000)]
    return spark.createDataFrame(data, "id int, declared string, host string, text string")


def test_fusion(rows):
    got = identify(rows)
    assert got.columns == ["id", "lang", "posterior", "kept"]
    found = {}
    for r in got.collect():
        found.setdefault(r.id, []).append(r)
    assert len(found[105]) == 2
    for i in range(40):
        assert found[i][0].lang == ("de" if i % 2 else "en") and found[i][0].kept
    assert found[100][0].lang == "de"  # the text outweighs a wrong declaration
    assert found[101][0].lang == "de"
    assert found[106][0].lang == "en"
    assert not any(found[i][0].kept for i in (102, 103, 104))
    assert found[103][0].lang == "de"  # declared, no text
    assert all(0 <= r.posterior <= 1 + 1e-9 for v in found.values() for r in v)


def test_evidence_beside_the_text(spark, rows):
    """Texts without any letters: the address and the declaration decide."""
    more = rows.union(spark.createDataFrame([(200, None, "h3.example.de", "1"), (201, None, "h2.example.com", "1"), (202, "de", "h2.example.com", "1")], rows.schema))
    got = {r.id: r for r in identify(more).where("id >= 200").collect()}
    assert (got[200].lang, got[201].lang) == ("de", "en")
    other = {r.id: r.posterior if r.lang == "de" else 1 - r.posterior for r in got.values()}
    assert other[202] > other[201]


def test_nothing_declared_and_no_rows(spark, rows):
    none = identify(rows.withColumn("declared", F.lit(None).cast("string"))).collect()
    assert len(none) == rows.count() and not any(r.kept or r.lang for r in none)
    assert identify(rows.limit(0)).count() == 0


def test_wanted(rows):
    assert {r.lang for r in identify(rows, wanted=["de"]).where("kept").collect()} == {"de"}


def test_stage(odd_docs, no_docs):
    left = keep_identified(odd_docs, "doc_id", "lang", "source", "text")
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 1, 2, 6, 7]
    assert keep_identified(no_docs, "doc_id", "lang", "source", "text").count() == 0


def test_declared_in(spark):
    pages = ["<!DOCTYPE html><html lang=\"fr\">", "<HTML class=a LANG='de-AT'>", "<html><p lang=en>", None, "<html lang=es>"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(declared_in(F.col("h"))).collect()]
    assert got == ["fr", "de", "", "", "es"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", "text")
    hidden = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("declared"), F.col("source").alias("host"), "text")
    got = identify(hidden).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").where("doc_id % 3 = 0")
    total, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("true")).cast("int"))).first()
    assert right / total >= 0.99


def test_rows_of_one_key_are_judged_apart(rows):
    same = rows.withColumn("id", F.when(F.col("id") % 2 == 0, 1))
    left = keep_identified(same, "id", "declared", "host", "text", by_row=True)
    verdicts = identify(rows.withColumn("whole", F.struct(*rows.columns))).where("kept").select("whole.declared", "whole.host", "whole.text")
    assert left.count() == verdicts.count() > 40 and left.drop("id").exceptAll(verdicts).count() == 0


def test_every_declared_language_counts(spark):
    """More languages than a block holds, each with words of its own; rare ones are as good as frequent ones."""
    codes = [a + b + c for a in "bcdfg" for b in "aeiouy" for c in "klmnprstvw"]
    text = {c: f"{c}{c[::-1]} {c[1:]}{c} {c[::-1]}q " * 12 for c in codes}
    data = [(i * 1000 + k, c, f"h.{c}", text[c]) for i, c in enumerate(codes) for k in range(2 if c != codes[-1] else 1)]
    hidden = [(900_000 + i, None, "", text[c]) for i, c in enumerate(codes)]
    got = {r.id: r for r in identify(spark.createDataFrame(data + hidden, "id int, declared string, host string, text string")).collect()}
    assert len(codes) == 300 and all(got[i].lang == c and got[i].kept for i, c, _, _ in data)
    assert [got[900_000 + i].lang for i in range(300)] == codes


def test_columns_with_names_that_are_used_inside(spark):
    inner = ["_grams", "_text", "_share", "_n", "_host", "_logs", "_top", "_row", "_domain_prior", "kept"]
    rows = [("en", "a.example.com", "the cat sat on the mat with the hat", *range(len(inner))), (None, None, None, *[None] * len(inner))]
    docs = spark.createDataFrame(rows, "declared string, host string, text string, " + ", ".join(f"{c} int" for c in inner))
    got = identify(docs)
    assert got.columns == [*inner[:-1], "lang", "posterior", "kept"]
    assert sorted(map(str, got.select(*inner[:-1]).collect())) == sorted(map(str, docs.select(*inner[:-1]).collect()))
    assert keep_identified(docs, "_n", "declared", "host", "text", by_row=True).columns == docs.columns
