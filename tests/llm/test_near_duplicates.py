import collections
import re

import numpy as np
import pytest

from rankloom.llm import near_duplicates as nd
from rankloom.llm.components import connected_components
from tests.llm.conftest import WORDS, prose


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_shingles_as_brute_force():
    texts = ["", None, "One", "a b c", "a b c d e", "a b c d e a b c d e", "!!", "é x, Y-z 1", prose(1, 50)]
    hashes, counts = nd.word_hashes(texts)
    at, value, times = nd.shingles(hashes, counts)
    for i, t in enumerate(texts):
        assert sorted(times[at == i].tolist()) == sorted(bag(t).values())
    both, n = nd.word_hashes(["x y z a b c", "q a b c", "A, b; C"])
    one = nd.shingles(both[-3:], n[-1:])[1]
    assert len(one) == 1 and nd.shingles(*nd.word_hashes(["a b c"]))[1][0] == one[0]


def test_draws_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(40):
        values = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
        wa = rng.uniform(0.5, 4, 400)
        wb = wa * rng.choice([1, 1, 1, 0.5, 0.1], 400)
        a, b = (nd.samples(np.zeros(400, int), values, w, 1) for w in (wa, wb))
        got.append(((a == b).mean(), np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()))
    estimate, truth = np.mean(got, axis=0)
    assert abs(estimate - truth) < 0.02


def test_weighted_jaccard():
    a, wa = np.array([1, 2, 3]), np.array([1.0, 2.0, 1.0])
    b, wb = np.array([2, 3, 4]), np.array([1.0, 3.0, 2.0])
    assert nd.weighted_jaccard(a, wa, b, wb) == pytest.approx(2 / 8)
    assert nd.weighted_jaccard(a, wa, a, wa) == 1


def test_sketch_counts_documents(spark, odd_docs):
    sketch, n = nd.frequency_sketch(odd_docs, "text")
    assert n == 6
    value = nd.shingles(*nd.word_hashes([odd_docs.where("doc_id = 1").first().text]))[1]
    assert np.minimum.reduce([sketch[c] for c in nd.cells_of(value)]).max() >= 3


@pytest.fixture(scope="module")
def groups(spark):
    """(id, text, group): exact copies, near copies of a base, and texts that share only a long passage."""
    rows, passage = [], prose(99, 70)
    for g in range(12):
        base = prose(1000 + g, 300).split()
        for i in range(9):
            words = list(base)
            for k in range(i // 3):
                words[(37 * i + 101 * k) % 300] = "changed"
            rows.append((g * 100 + i, " ".join(words), g))
    rows += [(5000 + i, prose(3000 + i, 150) + " " + passage, 100 + i) for i in range(60)]
    big = prose(7, 400).split()
    for i in range(150):
        words = list(big)
        for k in range(3):
            words[(17 * i + 131 * k) % 400] = WORDS[i % len(WORDS)] + str(i)
        rows.append((9000 + i, " ".join(words), 77))
    return spark.createDataFrame(rows, "doc_id bigint, text string, grp int")


def test_planted_groups(groups):
    got = {r.id: r for r in nd.classes(groups, "doc_id", "text").collect()}
    members = collections.defaultdict(list)
    for r in groups.collect():
        members[r.grp].append(r.doc_id)
    for ids in members.values():
        assert {got[i].class_id for i in ids} == {min(ids)}
        assert [i for i in ids if got[i].kept] == [min(ids)] and got[ids[0]].class_rows == len(ids)


def test_as_brute_force_on_given_documents(spark, small):
    """All pairs, weighed with exact document frequencies."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r for r in nd.classes(docs, "doc_id", "text").collect()}
    bags = {r.doc_id: bag(r.text) for r in docs.collect()}
    df = collections.Counter(s for b in bags.values() for s in b)
    weight = lambda s: 1 + math.log(1.1 / (df[s] / len(bags) + 0.1))
    where = collections.defaultdict(list)
    for i, b in bags.items():
        for s in b:
            where[s].append(i)
    parent = {i: i for i in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        shared = sum(min(n, bags[b][s]) * weight(s) for s, n in bags[a].items() if s in bags[b])
        total = sum(n * weight(s) for x in (a, b) for s, n in bags[x].items()) - shared
        if shared >= 0.8 * total:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert {i: got[i].class_id for i in bags} == {i: top(i) for i in bags}


def test_odd_documents(spark, odd_docs, no_docs):
    got = nd.classes(odd_docs, "doc_id", "text").collect()
    assert len(got) == odd_docs.count()
    same = [r for r in got if r.id in (1, 2)]
    assert {r.class_id for r in same} == {1} and sum(r.kept for r in same) == 1 and {r.class_rows for r in same} == {3}
    assert all(r.kept and r.class_id == r.id for r in got if r.id not in (1, 2))
    assert nd.classes(no_docs, "doc_id", "text").count() == 0
    left = nd.deduplicate(odd_docs, "doc_id", "text")
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "None"])
    assert nd.deduplicate(no_docs, "doc_id", "text").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (100, 100), (7, 200), (300, 301), (302, 301)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 200: 1, 100: 100, 101: 100, 300: 300, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("heavy", ["buy now " * 200, "one two three " * 150, "deal " * 400])
def test_few_heavy_shingles(spark, heavy):
    """Most of the weight lies in up to three shingles, and all others differ."""
    rows = [(g * 10 + i, f"word{g} " + heavy.replace(" ", f"{g} ") + prose(7000 + g * 10 + i, 12)) for g in range(6) for i in range(2)]
    got = {r.id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_pairs_inside_a_template_family(spark, monkeypatch):
    """All share a template (0.7 to 0.75); each has one partner at about 0.82.  As in a comparison of all pairs, with one block and with many."""
    import itertools
    import math

    rows, template = [], prose(500, 400)
    for g in range(60):
        mine = prose(20_000 + g, 22)
        rows += [(2 * g + i, f"{template} {mine} " + prose(30_000 + 2 * g + i, 34)) for i in range(2)]
    rows += [(1000 + i, prose(40_000 + i, 20)) for i in range(600)]
    bags = {i: bag(t) for i, t in rows}
    df = collections.Counter(s for b in bags.values() for s in b)
    weight = {s: 1 + math.log(1.1 / (n / len(rows) + 0.1)) for s, n in df.items()}
    total = {i: sum(n * weight[s] for s, n in b.items()) for i, b in bags.items()}
    alike = {}
    for a, b in itertools.combinations(range(120), 2):
        shared = sum(min(n, bags[b][s]) * weight[s] for s, n in bags[a].items() if s in bags[b])
        alike[a, b] = shared / (total[a] + total[b] - shared)
    assert all(0.8 < v < 0.85 if b == a + 1 and a % 2 == 0 else 0.65 < v < 0.79 for (a, b), v in alike.items())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (nd.BLOCK_BYTES, 50_000):
        monkeypatch.setattr(nd, "BLOCK_BYTES", size)
        got = {r.id: r.class_id for r in nd.classes(docs, "doc_id", "text").collect()}
        assert got == {i: i // 2 * 2 if i < 120 else i for i, _ in rows}


def test_rows_of_one_key_are_judged_apart(spark):
    near = prose(60_001, 200)
    rows = [(k, t) for k in (None, 5) for t in (near, near + " more", prose(60_002 + (k or 0), 200))] + [(7, near + " more"), (1, near)]
    left = nd.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("1", near), ("None", prose(60_002, 200)), ("5", prose(60_007, 200))])
