from collections import Counter

import pytest

from rankloom.llm.sharding import fill_table, hash60, place, slot_of, write_shards

NAMES = [f"s{i}" for i in range(7)]


def test_table_is_fair_and_follows_preferences():
    owner = fill_table(NAMES, 1009)
    counts = Counter(owner)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    taken = [-1] * 1009
    prefs = [[(hash60(f"start:{s}") + j * (hash60(f"step:{s}") % 1008 + 1)) % 1009 for j in range(1009)] for s in NAMES]
    for turn in range(1009):
        s = turn % 7
        taken[next(p for p in prefs[s] if taken[p] < 0)] = s
    assert owner == taken


def test_losing_a_shard_moves_little():
    before, after = fill_table(NAMES, 1009), fill_table(NAMES[:-1], 1009)
    moved = sum(a != b for a, b in zip(before, after) if a != 6)
    assert moved / 1009 < 0.12


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 2), (["a"], 10_000_019)])
def test_refused(shards, slots):
    with pytest.raises(ValueError):
        fill_table(shards, slots)


def test_placement(spark, odd_docs, no_docs, tmp_path):
    placed = place(odd_docs.withColumnRenamed("_row", "shard"), "doc_id", NAMES, 1009)
    assert placed.columns == ["doc_id", "text", "lang", "source", "_id", "slot", "shard"]
    rows, owner = placed.collect(), fill_table(NAMES, 1009)
    assert len(rows) == odd_docs.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == hash60(key) % 1009 and r.shard == NAMES[owner[r.slot]]
    assert place(no_docs, "doc_id", NAMES, 1009).count() == 0
    write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_plan_has_no_shuffle(odd_docs):
    plan = place(odd_docs, "doc_id", NAMES, 1009)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert slot_of is not None
