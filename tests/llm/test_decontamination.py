import re

import pytest
from pyspark.sql import functions as F

from rankloom.llm.decontamination import benchmark_windows, candidate_hits, covered_words, find_hits, hit_items, normal_words, remove_documents, remove_spans

ITEMS = "item_id bigint, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n=10):
    doc, hit, seen = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(n, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(doc) - k + 1 if k else 0):
            if tuple(doc[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                seen.add("" if item is None else str(item))
    return len(doc), len(hit), sorted(seen)


def digest(spark, docs, items, limit=None):
    windows = benchmark_windows(spark.createDataFrame(items, ITEMS), "item_id", "text")
    found = find_hits(docs, "text", windows, limit=limit)
    assert found.columns == [*docs.columns, "n_words", "hits"]
    return sorted(
        (tuple(r) for r in found.select("doc_id", "text", "n_words", covered_words(F.col("hits")), hit_items(F.col("hits"))).collect()), key=repr
    )


@pytest.mark.parametrize("limit", [None, 0])
def test_as_brute_force_with_short_items_and_overlaps(spark, odd_docs, limit):
    long = odd_docs.where("doc_id = 7").first().text.split(" ")
    one = odd_docs.where("doc_id = 1").first().text.split(" ")
    items = [
        (1, " ".join(one[20:45])),
        (2, " ".join(one[30:60])),
        (2, "Never found in any of these texts by its ten words"),
        (3, " ".join(long[15_000:15_012]).upper()),
        (4, " ".join(one[3:6])),
        (5, ""),
        (6, None),
        (None, ", ".join(long[29_990:])),
        (7, long[5]),
    ]
    want = sorted(((r.doc_id, r.text, *brute(r.text, items)) for r in odd_docs.collect()), key=repr)
    assert digest(spark, odd_docs, items, limit) == want


def test_no_items_and_no_documents(spark, odd_docs, no_docs):
    assert all(r[3] == 0 and r[4] == [] for r in digest(spark, odd_docs, []))
    assert digest(spark, no_docs, [(1, "a b c")]) == []


def test_outputs_replace_columns_of_their_name(spark):
    docs = spark.createDataFrame([(1, "one two", 9)], "doc_id int, text string, n_words int")
    windows = benchmark_windows(spark.createDataFrame([(1, "two")], ITEMS), "item_id", "text")
    row = find_hits(docs, "text", windows).first()
    assert (row.doc_id, row.n_words, len(row.hits)) == (1, 2, 1)


def test_texts_are_never_dealt_out_with_their_positions(spark, odd_docs):
    """Without a broadcast only hashes, row numbers and positions move to the join; with it no words are put together for a lookup."""
    windows = benchmark_windows(spark.createDataFrame([(1, "ba fo " * 8)], ITEMS), "item_id", "text")
    windows = windows.select("*")
    docs = odd_docs.select("doc_id", "text")
    cut = docs.select(F.struct("doc_id").alias("_row"), F.monotonically_increasing_id().alias("_id"), normal_words(F.col("text")).alias("_words"))
    cut = cut.withColumn("_n", F.size("_words"))
    hashes = windows.select("_key", "_len")
    lookup = candidate_hits(cut, hashes, [10], 1 << 20)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in lookup.splitlines() if "BroadcastHashJoin" in line)
    assert "array_join" not in join and "slice" not in join
    dealt = candidate_hits(cut, hashes, [10], 0)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(dealt) if "Exchange hashpartitioning(key" in line)
    assert "_words" not in dealt[at + 1].split("Project", 1)[-1]


def test_columns_called_like_the_outputs_stay(spark):
    docs = spark.createDataFrame([(1, "a b one two c", 77, "h")], "doc_id int, text string, n_words int, hits string")
    windows = benchmark_windows(spark.createDataFrame([(1, "one two")], ITEMS), "item_id", "text")
    assert [tuple(r) for r in remove_spans(docs, "text", windows).collect()] == [(1, "a b c", 77, "h")]


def test_removal(spark, odd_docs):
    one = odd_docs.where("doc_id = 1").first().text.split(" ")
    windows = benchmark_windows(spark.createDataFrame([(1, " ".join(one[10:22]))], ITEMS), "item_id", "text")
    left = remove_documents(odd_docs, "doc_id", "text", windows)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "4", "5", "6", "7", "8", "None", "None"])
    cut = remove_spans(odd_docs, "text", windows)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    text = {r.doc_id: r.text for r in cut.collect()}
    assert text[1] == " ".join(one[:10] + one[22:])
    assert text[3] is None and text[4] == "" and text[8] == "*** ### $$$"


def test_rows_of_one_key_are_judged_apart(spark):
    bad, rows = "a b c d e f g h i j k l", [(k, t) for k in (None, 1) for t in ("x y z a b c d e f g h i j k", "all clean", None)]
    windows = benchmark_windows(spark.createDataFrame([(1, bad)], ITEMS), "item_id", "text")
    left = remove_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", windows).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((k, t) for k in ("None", "1") for t in ("all clean", "None"))
