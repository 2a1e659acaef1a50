"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target number of words.  Its documents, in the order of a
digest, form a stream of words that is repeated as often as the target needs
and cut into blocks of equally many words.  The schedule is a row of slots:
slot i has the point frac(i * golden ratio), the cumulative shares of the
sources map the point to a source, and the source's k-th slot takes its k-th
block.  So after any number of slots each source is within a few blocks of its
share.  Blocks that no slot has taken (a source may fall short by a few)
follow at the end; hence exactly the rounded target is taken.

Sources are a table like any other: their targets, shares and places are
computed by joins and sums, however many there are.  Documents are ordered by
one range sort whose last key tells all rows apart, with running sums per range
and offsets between ranges, and slots by two levels of counts: no task holds a
source, nor all rows that share an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import NOT_GAP, digest_of, free_name, join_rows
from rankloom.operators.chunks import number_rows, written_once
from rankloom.operators.sizing import broadcast_if_small

BLOCK = 1024
#: points are multiples of 2 ** -31; the odd number next to golden ratio * 2 ** 31 steps through all of them
POINTS, STEP = 1 << 31, 1327217885
CHUNK = 1 << 16
#: stretches that the points are divided into, at least
STRETCHES = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_GAP)), F.lit(0)).cast("bigint")


def source_quotas(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(_s, source, source_size, target, quota) for the sources of ``sized`` (source, size).

    ``share`` times all words are to be taken, in proportion to the weights
    and at most ``most`` times the size of a source.  Sources in code point
    order, null last, are numbered from 0 and have the weights in turn.  What a
    limit leaves over is shared by weight among the others until none is above
    its limit; if all reach it, the rest is not given out.  A round of sharing
    is one aggregation over the sources; only its sums reach the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = written_once(number_rows(sums, [F.col("source").isNull(), F.col("source")], out="_s"), "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_s") % len(weights)).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    fixed, before = F.lit(None).cast("double"), None
    while True:
        row = rows.agg(F.sum(F.when(fixed.isNull(), weight)).alias("open"), F.sum(fixed).alias("given"), F.count(fixed).alias("n")).first()
        if not row["open"]:
            target = fixed
            break
        level = (total - (row["given"] or 0.0)) / row["open"]
        if row["n"] == before:  # the last round has reached no further limit
            target = F.coalesce(fixed, F.lit(level) * weight)
            break
        before = row["n"]
        fixed = F.coalesce(fixed, F.when(F.lit(level) * weight > limit, limit))
    rows = rows.select("_s", "source", "source_size", target.alias("target"))
    return written_once(rows.withColumn("quota", F.bround("target", 0).cast("bigint")), "quotas")


def running_total(rows: DataFrame, number: str, value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of a lesser dense ``number``, in two levels."""
    rows = rows.withColumn("_part", F.expr(f"{number} div {CHUNK}")).withColumn("_value", value)
    inside = Window.partitionBy("_part").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.sum("_value").alias("_all"))  # one row for 65,536 sources
    parts = parts.select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_first"))
    rows = rows.withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(parts, "_part")
    return rows.withColumn(out, (F.col(out) + F.col("_first")).cast("bigint")).drop("_part", "_value", "_first")


def schedule(quotas: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, _s, block): which source's block each slot takes; one slot for each block on average."""
    spark = quotas.sparkSession
    blocks = F.ceil(F.col("quota") / block).cast("bigint")
    slots, sources = quotas.agg(F.coalesce(F.sum(blocks), F.lit(0)), F.count(F.lit(1))).first()
    if not slots:
        return spark.range(0).select(F.col("id").alias("slot"), F.col("id").alias("_s"), F.col("id").alias("block"))
    edges = running_total(quotas.select("_s", "quota"), "_s", blocks, "_before").withColumn("_after", F.col("_before") + blocks)
    at = lambda c: F.expr(f"cast({c} as decimal(20,0)) * {POINTS} div {slots}").cast("bigint")
    edges = edges.select("_s", at("_before").alias("_low"), at("_after").alias("_high")).where("_low < _high")
    # points and the spans of sources meet by stretch; a source has one slot's width or more, so few share a stretch
    stretches = min(slots, max(STRETCHES, 4 * sources), POINTS)
    stretch = lambda c: F.expr(f"({c} * {stretches}) div {POINTS}")
    spans = edges.withColumn("_stretch", F.explode(F.sequence(stretch("_low"), stretch("(_high - 1)"))))
    point = (F.col("id") % POINTS) * STEP % POINTS
    rows = spark.range(slots).select(F.col("id").alias("slot"), point.alias("_point")).withColumn("_stretch", stretch("_point"))
    rows = rows.join(broadcast_if_small(spans), "_stretch").where("_point >= _low AND _point < _high")
    rows = rows.select("slot", "_s", F.expr(f"slot div {CHUNK}").alias("_chunk"))
    before = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_s", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_s", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_s", "_chunk").orderBy("slot")) - 1
    return rows.withColumn("_nth", nth).join(counts, ["_s", "_chunk"]).select("slot", "_s", (F.col("_first") + F.col("_nth")).alias("block"))


def placed_documents(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """``sized`` (id, source, size and any others) with each row's place in its source's stream of words.

    Rows are ordered by a digest of source and id, then by all columns; equal
    rows stay apart by a number of their own.  ``_at`` names the row.
    """
    digest = F.md5(F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    others = [c for c in sized.columns if c not in ("id", "source", "size")]
    known = broadcast_if_small(quotas).withColumnRenamed("source", "_source")
    rows = sized.withColumns({"_order": digest, "_row": F.monotonically_increasing_id()})
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ordered = rows.orderBy("_s", "_order", "id", "size", *others, "_row").drop("_order", "_row")
    rows = written_once(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_s", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_s", "_part").agg(F.sum("size").alias("_words"))
    starts = starts.select("_s", "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(starts, ["_s", "_part"]).withColumn("start", F.col("_before") + F.col("_inside"))
    return rows.drop("_before", "_inside", "_part")


def pieces(placed: DataFrame, slots: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """The mix: every piece of a document that lies in one taken block, with its slot.

    ``epoch`` counts repetitions of the source, ``first`` and ``words`` are the
    piece's words within the document.  A document without taken words has one
    row without a slot.
    """
    epochs = F.sequence(F.lit(0), F.lit(most - 1))
    low = lambda e: e * F.col("source_size") + F.col("start")
    runs = F.filter(
        F.transform(epochs, lambda e: F.struct(e.alias("epoch"), low(e).alias("low"), F.least(low(e) + F.col("size"), F.col("quota")).alias("high"))),
        lambda r: r["low"] < r["high"],
    )
    cut = placed.withColumn("_run", F.explode_outer(runs))
    cut = cut.withColumn("block", F.explode_outer(F.expr(f"sequence(_run.low div {block}, (_run.high - 1) div {block})")))
    low, high = F.greatest(F.col("_run.low"), F.col("block") * block), F.least(F.col("_run.high"), (F.col("block") + 1) * block)
    cut = cut.select(
        *placed.columns, "block", F.col("_run.epoch").alias("epoch"), (low - F.col("_run.low")).alias("first"), (high - low).alias("words")
    )
    return cut.join(slots, ["_s", "block"], "left").withColumn("late", F.col("slot").isNull() & F.col("block").isNotNull())


def mix(sized: DataFrame, weights: Sequence[float], share: float, most: int, block: int = BLOCK) -> DataFrame:
    """The pieces of the mix over ``sized`` (id, source, size and any others); see ``pieces``.

    ``share`` is the total to take as a multiple of all words; no source, and
    no document, is taken more than ``most`` times over.  Reruns give the same
    rows.  ``sized`` is read twice, so it should be stored.
    """
    quotas = source_quotas(sized, weights, share, most)
    return pieces(placed_documents(sized, quotas), schedule(quotas, block), most, block)


def taken_words(mixed: DataFrame) -> DataFrame:
    """One row per row of the sized documents: how many words the mix takes, repeats counted."""
    return mixed.groupBy("_at").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("id", "source", "size", "source_size", "target")],
        F.coalesce(F.sum("words"), F.lit(0)).alias("taken"),
    )


def mix_documents(
    docs: DataFrame, key: str, source: str, text: str, weights: Sequence[float], share: float = 1.5, most: int = 2
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes more than half of them, all columns.

    Each row is taken by its own key, source and text, also where many share a
    key or have none (null counts as a value); rows equal in all three are
    taken together.  Documents without words are not taken.
    """
    name = free_name(docs.columns, "_digest")
    marked = docs.withColumn(name, digest_of(F.col(f"`{text}`")))
    sized = marked.groupBy(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(name).alias("digest"))
    sized = sized.agg(F.sum(word_count(F.col(f"`{text}`"))).alias("size"))
    mixed = mix(written_once(sized, "sizes"), weights, share, most)
    epochs = mixed.where("words > 0").groupBy("_at", "epoch").agg(
        *[F.first(c, ignorenulls=True).alias(f"_{c}") for c in ("id", "source", "digest")], (F.sum("words") * 2 > F.first("size")).alias("most")
    )
    times = free_name([*docs.columns, name], "_copies")
    copies = epochs.where("most").groupBy("_id", "_source", "_digest").agg(F.count(F.lit(1)).cast("int").alias(times))
    repeated = join_rows(marked, [key, source, name], copies.withColumnRenamed("_digest", "_text_digest"), "inner").drop(name)
    return repeated.select(*[f"`{c}`" for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(times)).drop(times)
