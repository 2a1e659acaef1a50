import pytest
from pyspark.sql import functions as F

from rankloom.llm.mixing import mix, mix_documents, schedule, source_quotas, taken_words, word_count


def targets(sizes, weights, total, most):
    """Plain sharing: (source, size, target) in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    open_, given, left = set(range(len(order))), [0.0] * len(order), float(total)
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if level * weight[i] > most * order[i][1]}
        for i in full or open_:
            given[i] = float(most * order[i][1]) if full else level * weight[i]
            left -= given[i] if full else 0
        if not full:
            break
        open_ -= full
    return [(name, size, t) for (name, size), t in zip(order, given)]


@pytest.mark.parametrize(
    "sizes", [[("b", 100), ("a", 1000), (None, 50), ("c", 0)], [], [("a", 10)], [(f"s{i:03}", (i * i * 7919) % 5000) for i in range(250)]]
)
def test_targets(spark, sizes):
    """Shares, limits and what they leave over, as by a plain loop; the last case has many sources."""
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "id bigint, source string, size bigint")
    got = [tuple(r) for r in source_quotas(df, (3, 1, 2), 1.5, 2).orderBy("_s").select("_s", "source", "source_size", "target", "quota").collect()]
    want = targets(sizes, (3, 1, 2), 1.5 * sum(n for _, n in sizes), 2)
    assert got == [(i, s, n, t, round(t)) for i, (s, n, t) in enumerate(want)]


def sized(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, size bigint")


def test_whole_mix(spark):
    rows = [(i, "abc"[i % 3] if i % 10 else None, (i * 37) % 500) for i in range(600)] + [(5, "c", 185), (None, "a", 7), (None, "a", 7), (9, None, 0), (9, None, 0)]
    df = sized(spark, rows)
    quotas = source_quotas(df, (3, 1, 2), 1.5, 2).collect()
    mixed = mix(df, (3, 1, 2), 1.5, 2, block=64)
    got = taken_words(mixed).collect()
    assert sorted((r.id, r.source, r.size) for r in got if r.id is not None and r.source) == sorted(r for r in rows if r[0] is not None and r[1])
    assert len(got) == len(rows)
    for q in quotas:
        own = [r for r in got if r.source == q.source]
        assert sum(r.taken for r in own) == q.quota and sum(r.size for r in own) == q.source_size
        assert all(r.taken <= 2 * r.size for r in own)
    again = taken_words(mix(df.repartition(5), (3, 1, 2), 1.5, 2, block=64)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    slots = mixed.where("slot is not null").groupBy("slot", "_s", "block").agg(F.sum("words").alias("w")).collect()
    assert len({r.slot for r in slots}) == len(slots) and all(r.w <= 64 for r in slots)
    assert mixed.where("late").count() <= 0.05 * mixed.count()


def test_schedule_keeps_every_prefix_near_the_shares(spark):
    sizes = [500_000, 300_000, 200_000]
    quotas = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "_s bigint, quota bigint")
    rows = schedule(quotas, 100).orderBy("slot").collect()
    seen = [0, 0, 0]
    assert [r.slot for r in rows] == list(range(len(rows)))
    for i, r in enumerate(rows):
        assert r.block == seen[r._s]
        seen[r._s] += 1
        assert all(abs(seen[k] - (i + 1) * sizes[k] / 1_000_000) < 4 for k in range(3))


def test_schedule_of_more_sources_than_a_list_should_hold(spark):
    """Every slot has one source, each source about as many slots as blocks."""
    quotas = spark.range(150_000).select(F.col("id").alias("_s"), (F.col("id") % 5 * 1024).alias("quota"))
    rows = schedule(quotas).groupBy("_s").agg(F.count("*").alias("n"), F.max("block").alias("last"))
    both = quotas.join(rows, "_s", "left").select("_s", (F.col("quota") / 1024).alias("blocks"), F.coalesce("n", F.lit(0)).alias("n"), "last")
    total, wrong, far = both.agg(F.sum("n"), F.count_if(F.col("last") != F.col("n") - 1), F.max(F.abs(F.col("n") - F.col("blocks")))).first()
    assert total == 300_000 and wrong == 0 and far <= 3


def test_rows_that_share_a_key_are_mixed_by_their_own_text(spark):
    """With a third of the keys null the sources come as near their targets as with distinct ones."""
    rows = [(None if i % 3 == 0 else i, f"w{i} " * (1 + i * 13 % 40), "abcd"[i * i % 4]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sized_ = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    goals = {q.source: q.target for q in source_quotas(sized_, (3, 1, 2), 1.5, 2).collect()}
    got = mix_documents(docs, "doc_id", "source", "text", (3, 1, 2)).groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()
    assert {r.source for r in got} == set(goals)
    assert all(abs(r.n - goals[r.source]) <= 0.02 * goals[r.source] + 40 for r in got)


def test_documents(spark, odd_docs, no_docs):
    got = mix_documents(odd_docs, "doc_id", "source", "text", (3, 1, 2), 1.5, 2)
    assert got.columns == odd_docs.columns
    texts = {r.text for r in odd_docs.where(word_count(F.col("text")) > 0).collect()}
    assert {r.text for r in got.collect()} - {None} <= texts and got.count() > 0
    assert mix_documents(no_docs, "doc_id", "source", "text", (3, 1, 2), 1.5, 2).count() == 0
