import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.automaton import Automaton, build, matching, window_ranks
from rankloom.llm.substrings import remove_repeats, window_keys, with_repeats
from tests.llm.conftest import prose


def brute(rows, window=50):
    """(id, words, removed words, kept text) of rows (id, text)."""
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in cut:
        for s in range(len(w) - window + 1) if i is not None else ():
            gram = b" ".join(w[s : s + window])
            low[gram] = min(i, low.get(gram, i))
    out = []
    for i, w in cut:
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if low[b" ".join(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_automaton_as_brute_force():
    draw = random.Random(2)
    for _ in range(150):
        window, kinds = draw.randint(1, 6), draw.choice([1, 2, 3, 6])
        texts = [[draw.randrange(kinds) for _ in range(draw.randint(0, 25))] for _ in range(draw.randint(0, 6))]
        ranks = [draw.randrange(9) for _ in texts]
        asked = [[draw.randrange(kinds + 1) for _ in range(draw.randint(0, 25))] for _ in range(4)] + texts
        made = Automaton.unpack(build([np.array(t, np.uint64) for t in texts], ranks, window).pack())
        arrays = [np.array(t, np.uint64) for t in asked]
        lengths, found = matching(made, arrays)[0], window_ranks(made, arrays, window)
        for row, one in enumerate(asked):
            for t in range(len(one)):
                inside = lambda part: [r for x, r in zip(texts, ranks) if any(x[j : j + len(part)] == part for j in range(len(x) - len(part) + 1))]
                assert lengths[row, t] == max([k for k in range(1, t + 2) if inside(one[t + 1 - k : t + 1])], default=0)
                assert found[row, t] == (min(inside(one[t + 1 - window : t + 1]), default=-1) if t + 1 >= window else -1)


def test_keys_depend_on_the_window_alone():
    draw = np.random.default_rng(5)
    codes = draw.integers(0, 1 << 60, 400).astype(np.uint64)
    text, at, key = window_keys(np.concatenate([codes, codes[100:300], codes[:49]]), np.array([400, 0, 200, 49]), 50)
    held = {(t, a): k for t, a, k in zip(text.tolist(), at.tolist(), key.tolist())}
    assert [held[0, 100 + i] for i in range(151)] == [held[2, 400 + i] for i in range(151)]
    assert len(held) == 351 + 151


@pytest.fixture(scope="module")
def planted():
    """Passages, near copies, a passage in very many texts, one word often, and texts that hold a passage twice."""
    draw = random.Random(11)
    passages = [prose(100 + i, draw.randint(50, 130)) for i in range(6)]
    rows = []
    for i in range(150):
        parts = [prose(1000 + i, draw.randint(0, 120)), draw.choice(passages), prose(2000 + i, draw.randint(0, 90))]
        rows.append((draw.randrange(80), " ".join(parts)))
    body = prose(77, 400).split()
    for i in range(40):
        near = list(body)
        for _ in range(draw.randint(0, 4)):
            near[draw.randrange(400)] = f"new{i}"
        rows.append((200 + i, "\t".join(near)))
    rows += [(300, "so " * 500), (301, "so " * 300 + "x"), (302, passages[0] + " " + passages[0]), (None, passages[1]), (303, None), (304, " \n"), (-5, passages[2])]
    return rows


@pytest.mark.parametrize("limits", [{}, {"limit": 0, "shard_words": 300}, {"hot": 2, "shard_words": 500}, {"hot": 0, "limit": 0}])
def test_as_brute_force_however_it_is_dealt(spark, planted, limits):
    docs = spark.createDataFrame(planted, "doc_id bigint, text string")
    assert digest(with_repeats(docs, "doc_id", "text", ["doc_id"], **limits)) == brute(planted)


def test_short_windows_and_text_ids(spark, planted):
    rows = [(None if i is None else f"k{i % 7}", t) for i, t in planted[:60]]
    docs = spark.createDataFrame(rows, "name string, body string")
    for window in (1, 5, 17):
        assert digest(with_repeats(docs, "name", "body", ["name"], window)) == brute(rows, window)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(90).cast("bigint")))
    found = with_repeats(docs, "doc_id", "text", docs.columns)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert digest(found.select("doc_id", "n_words", "n_removed", "kept")) == brute([(r.doc_id, r.text) for r in docs.collect()])
    left = remove_repeats(docs, "doc_id", "text")
    assert left.columns == docs.columns and left.count() == docs.count()
    assert {r.text for r in left.where("doc_id = 90").collect()} == {""}
    assert sorted(map(repr, left.where("doc_id is null or doc_id < 90").collect())) == sorted(map(repr, odd_docs.collect()))
    assert with_repeats(no_docs, "doc_id", "text", ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        with_repeats(docs.withColumn("kept", F.lit(1)), "doc_id", "text", ["kept"])
