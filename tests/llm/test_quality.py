import collections
import re

import pytest
from pyspark.sql import functions as F

from rankloom.llm.quality import fit_votes, judge, measures


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a", "a b a b a b a", "x\ny\nx\n\n x\nx", "\x1c not a gap \x0b\x0c\r\n#*$%&|<>",
    "é漢 😀 é漢 😀 é漢 😀", ("lorem ipsum dolor " * 5000).strip(), "a  b\tc\nd a b c d",
]


def test_measures_as_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string")
    got = measures(docs, "text", ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted([(i, *brute(t)) for i, t in enumerate(TEXTS)] * 2)


def test_all_rows_and_verdicts(spark, odd_docs, no_docs):
    rows, model = judge(odd_docs, "text", ["doc_id"])
    found = rows.collect()
    assert len(found) == odd_docs.count() and all(0 <= r.quality <= 1 for r in found)
    assert 0 < model.prior < 1
    assert judge(no_docs, "text", ["doc_id"])[0].count() == 0


def test_posterior_column_equals_model(spark, odd_docs):
    rows, model = judge(odd_docs, "text", ["doc_id"])
    names = [c for c in rows.columns if c.startswith("vote_")]
    for r in rows.collect():
        assert r.quality == pytest.approx(model.posterior([r[n] for n in names]))


def test_estimates_recover_accuracies():
    import itertools

    right, patterns = [0.9, 0.8, 0.95], collections.Counter()
    for good in (True, False):
        for votes in itertools.product((1, -1), repeat=3):
            share = 0.7 if good else 0.3
            for v, a in zip(votes, right):
                share *= a if (v > 0) == good else 1 - a
            patterns[votes] += round(1e6 * share)
    model = fit_votes(list(patterns.items()), 3, steps=400)
    assert model.accuracy == pytest.approx(right, abs=0.01) and model.prior == pytest.approx(0.7, abs=0.01)
    assert fit_votes([], 2).accuracy == [0.8, 0.8]


def test_labelled_documents(spark, small):
    rows, _ = judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text", ["doc_id"])
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = F.col("good") & (F.col("n_words") >= 50) & (F.col("n_repeat_words") * 2 <= F.col("n_words"))
    table = {(r.quality_, r.kept): r["count"] for r in rows.join(labels.withColumnRenamed("quality", "quality_"), "doc_id").groupBy("quality_", kept.alias("kept")).count().collect()}
    long_good = rows.join(labels.withColumnRenamed("quality", "quality_"), "doc_id").where("quality_ = 1 and n_words >= 50 and n_repeat_words * 2 <= n_words")
    assert long_good.where("not good").count() == 0
    assert table.get((0, True), 0) <= 0.05 * table[(0, False)]


def test_columns_called_like_outputs_or_inner_names(spark, odd_docs):
    docs = odd_docs.withColumnsRenamed({"lang": "n_words", "source": "_t"}).withColumn("vote_plain", F.lit(5)).withColumn("good", F.lit("x"))
    rows, _ = judge(docs, "text", docs.columns)
    kept = [c for c in docs.columns if c not in ("n_words", "vote_plain", "good")]
    assert rows.columns[: len(kept)] == kept and len(set(rows.columns)) == len(rows.columns)
    assert sorted(map(repr, rows.select(*kept).collect())) == sorted(map(repr, docs.select(*kept).collect()))
    assert dict(rows.dtypes)["good"] == "boolean" and rows.where("n_words is null").count() == 0
    assert measures(docs, "text", ["_t", "n_words"]).columns[:2] == ["_t", "n_words"]
