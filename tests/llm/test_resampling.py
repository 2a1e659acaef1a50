import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm.op12_resampling import op12_resampling
from rankloom.llm.resampling import features, gains, joined_crc, ranked, resample, scored


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, bench, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in bench:
        t.update(buckets(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows, able = [], []
    for doc_id, text in docs:
        held = buckets(text)
        weight = sum(gain[b] for b in held)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(held), weight, score, None])
        if len(words(text)) >= 20:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=repr)


def test_checksums_of_joined_strings():
    pairs = [(b"", b"a"), (b"abc", b" de"), ("ünï".encode(), b" " + b"x" * 5000), (b"q" * 300, b""), (b"", b"")]
    one, two = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    assert joined_crc(one, two, np.array([len(p[1]) for p in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_features_of_texts():
    texts = ["Hello, World hello!", "", None, "a", "a b c a b c Ünï İx" * 3, "x" * 5000 + " y z", "-- ++"]
    counts, grams = features(pa.array(texts), 10_000, 3)
    for i, text in enumerate(texts):
        assert counts[i] == len(words(text))
        got = [b for bucket, ends in grams for b in bucket[(ends[i - 1] if i else 0) : ends[i]].tolist()]
        assert got == buckets(text)


def test_query_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = op12_resampling(spark, small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(t == "bigint" for _, t in got.dtypes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([tuple(r) for r in docs], bench)


@pytest.mark.parametrize("bench", [["ran tis lom baran batis " * 9, None], []])
def test_odd_rows(spark, odd_docs, no_docs, bench):
    docs = odd_docs.where("doc_id != 1 or doc_id is null").unionByName(odd_docs.where("doc_id = 1").limit(1))
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id int, text string")
    gain = gains(docs, target, "text", "text")
    rows = ranked(scored(docs, "doc_id", "text", gain), 60).select("id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], bench, 60)
    drawn = resample(docs, "doc_id", "text", target, "text", 60)
    assert drawn.columns == docs.columns
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r.id) for r in rows if r.rank)
    assert resample(no_docs, "doc_id", "text", target, "text", 60).collect() == []


def test_equal_rows_are_drawn_together_and_counted_apart(spark, odd_docs):
    target = spark.createDataFrame([("ran tis",)], "text string")
    gain = gains(odd_docs, target, "text", "text")
    ranks = [r["rank"] for r in ranked(scored(odd_docs, "doc_id", "text", gain), 100).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, len([r for r in ranks if r]) + 1))
    assert resample(odd_docs, "doc_id", "text", target, "text", 100).where("doc_id = 1").count() == 2
