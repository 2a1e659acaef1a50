import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.op11_periodic_runs import op11_periodic_runs
from rankloom.llm.periodic import PRIME, collapse_runs, greatest_run, inverse, roots, run_lines, runs_of, seeds, slow_runs, transform, with_runs


def brute(words):
    """Runs (start, length, period), period by period with plain loops over equal neighbours."""
    found, n = {}, len(words)
    codes = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.empty(0)
    for q in range(1, n // 4 + 1):
        same = codes[:-q] == codes[q:]
        breaks = np.concatenate([[-1], np.flatnonzero(~same), [n - q]])
        lengths = np.diff(breaks) - 1 + q
        for i in np.flatnonzero(lengths >= max(6, 4 * q)).tolist():
            found.setdefault((int(breaks[i]) + 1, int(lengths[i])), q)
    return sorted((s, n_, q) for (s, n_), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digests(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None, sha(lines), sha(collapsed(words, runs)))


def test_transform_there_and_back():
    rows = np.random.default_rng(1).integers(0, PRIME, (5, 64)).astype(np.uint64)
    there = transform(rows)
    assert np.array_equal(inverse(there), rows)
    negative = roots(64)[2]
    shared = inverse(there[:, negative] * there % np.uint64(PRIME))  # correlation of each row with itself
    want = [[sum(int(a) * int(b) for a, b in zip(r, np.roll(r, -o))) % PRIME for o in range(64)] for r in rows]
    assert shared.tolist() == want


def test_seeds_are_all_blocks_that_come_again():
    draw = random.Random(3)
    for block in (1, 2, 4, 8):
        codes = [draw.randrange(2) for _ in range(20 * block)]
        padded = np.array([*codes, *range(10, 10 + 2 * block)], np.uint64)
        want = {
            (k, d)
            for k in range(0, len(codes), block)
            for d in range(block, 2 * block)
            if k + d + block <= len(padded) and padded[k : k + block].tolist() == padded[k + d : k + d + block].tolist()
        }
        assert set(zip(*(x.tolist() for x in seeds(padded, block)))) == want


def test_runs_as_period_by_period():
    draw = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(1, 6)):
            kinds = draw.choice([1, 2, 3, 9])
            text = [draw.randrange(kinds) for _ in range(draw.randint(0, 40))]
            if draw.random() < 0.6:
                base = [draw.randrange(5) for _ in range(draw.randint(1, 11))]
                text += base * draw.randint(3, 7) + base[: draw.randint(0, len(base))] + text[:4]
            texts.append(text)
        codes, ends = np.array([c for t in texts for c in t], np.uint64), np.cumsum([len(t) for t in texts], dtype=np.int64)
        want = []
        for t, e in zip(texts, ends.tolist()):
            want += [(e - len(t) + s, e - len(t) + s + n, q) for s, n, q in brute(t)]
        assert sorted(map(tuple, runs_of(codes, ends).tolist())) == sorted(want)
        assert sorted(slow_runs(codes, ends)) == sorted(want)


def test_one_word_many_times_is_one_run():
    assert runs_of(np.zeros(40_000, np.uint64), np.array([40_000])).tolist() == [[0, 40_000, 1]]


def test_query_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = op11_periodic_runs(spark, small)
    assert [c for c, _ in got.dtypes] == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digests(d.doc_id, d.text) for d in docs), key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(9, "q " + "go on " * 4 + "x", "en", "d", 1, "x"), (10, "a " * 5, "en", "d", 1, "x")], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    found = with_runs(docs, "text", docs.columns)
    assert found.columns == [*docs.columns, "n_words", "runs", "collapsed"] and found.count() == docs.count()
    for r in found.collect():
        words = (r.text or "").encode().split()
        runs = brute([w.decode() for w in words])
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed == collapsed([w.decode() for w in words], runs)
    assert with_runs(no_docs, "text", ["doc_id"]).collect() == []
    row = found.where("doc_id = 9").select(greatest_run(F.col("runs")).alias("b"), run_lines(F.col("runs")).alias("l")).first()
    assert (tuple(row.b), row.l) == ((1, 8, 2), "1,8,2\n")
    left = collapse_runs(docs, "text")
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect() if r.doc_id in (4, 9, 10)} == {4: "", 9: "q go on x", 10: "a " * 5}
    assert sorted(map(repr, left.where("doc_id < 9 or doc_id is null").collect())) == sorted(map(repr, odd_docs.collect()))


def test_names_of_outputs_are_refused_and_others_pass(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id int, text string, runs int")
    with pytest.raises(ValueError):
        with_runs(docs, "text", ["doc_id", "runs"])
    assert collapse_runs(docs, "text").collect() == docs.collect()
    assert with_runs(docs.toDF("_text", "_row", "_"), "_row", ["_text", "_row", "_"]).columns == ["_text", "_row", "_", "n_words", "runs", "collapsed"]
