"""Benchmark decontamination: find benchmark passages in training texts by their word n-grams.

A window is ``n`` consecutive words of a benchmark item, or all words of a
shorter item.  The hashes of all windows, eight bytes each, form the broadcast
set; every document is cut into words once and each position's hash is looked
up in it.  Only the few positions found there have their words put together and
compared with the window's: a match counts after that.  Everything is
expressions inside generated code: one scan, one slim shuffle of (document,
hits) rows.  The set is broadcast only while its measured size allows it; for a
larger one (hash, document, position) rows meet the hashes in a shuffled join,
and the words are looked at again only where documents have candidates.  Items
are joined last, once for each window that a document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import digest_of, free_name, join_rows, lower_ascii, split_words
from rankloom.operators.chunks import written_once
from rankloom.operators.sizing import BROADCAST_LIMIT, broadcast_if_small, measured_bytes

#: everything in ASCII that is neither a digit nor a small letter
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def normal_words(text: Column) -> Column:
    return split_words(lower_ascii(text), WORD_GAP)


def window_hash(words: Column, start: Column | int, length: int) -> Column:
    return F.xxhash64(*[F.get(words, F.lit(start) + k if k else F.lit(start)) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, item: str, text: str, n: int = WINDOW) -> DataFrame:
    """One row per distinct window: its hash, words (joined by spaces), length and the items that hold it.

    Items without words have none.  An item without an id takes part under an
    empty id; items that share an id count as one.
    """
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), normal_words(F.col(text)).alias("_words")
    ).withColumn("_len", F.least(F.size("_words"), F.lit(n)))
    windows = items.where("_len > 0").select(
        "_item", "_words", "_len", F.explode(F.expr("sequence(0, size(_words) - _len)")).alias("_start")
    )
    key = F.coalesce(*[F.when(F.col("_len") == k, window_hash(F.col("_words"), F.col("_start"), k)) for k in range(1, n + 1)])
    joined = F.array_join(F.slice("_words", F.col("_start") + 1, F.col("_len")), " ")
    return (
        windows.select(key.alias("_key"), joined.alias("_window"), "_len", "_item")
        .groupBy("_key", "_window", "_len")
        .agg(F.collect_set("_item").alias("_items"))
    )


#: bytes of window hashes that are broadcast
SET_LIMIT = BROADCAST_LIMIT


def window_text(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def position_hashes(lengths: list[int]) -> Column:
    """(len, key) for every window length at the position ``_at`` of ``_words``; no key where the text ends before."""
    fits = lambda k: F.col("_at") + k <= F.col("_n")
    return F.array(*[F.struct(F.lit(k).alias("len"), F.when(fits(k), window_hash(F.col("_words"), F.col("_at"), k)).alias("key")) for k in lengths])


def candidate_hits(cut: DataFrame, hashes: DataFrame, lengths: list[int], limit: int) -> DataFrame:
    """``cut`` (_row, _id, _words, _n) as (_row, _id, _n, _at, _len, _text): the windows whose hash is known, with their words.

    A text without any has one row without a position.
    """
    if measured_bytes(hashes) <= limit:
        spots = cut.select("*", F.posexplode_outer("_words").alias("_at", "_word"))
        one = position_hashes(lengths)
        spots = spots.withColumn("_k", one[0] if len(lengths) == 1 else F.explode(one))
        spots = spots.select("_row", "_id", "_words", "_n", "_at", F.col("_k.key").alias("_hash"), F.col("_k.len").alias("_long"))
        known = F.broadcast(hashes.withColumn("_known", F.lit(True)))
        found = spots.join(known, (F.col("_hash") == F.col("_key")) & (F.col("_long") == F.col("_len")), "left")
        found = found.where(F.col("_known") | F.col("_at").isNull() | (F.col("_at") == 0)).withColumn("_i", F.col("_at"))
    else:
        cut = written_once(cut, "cut")  # so that both uses see the same numbers
        spots = cut.select("_id", "_words", "_n", F.posexplode("_words").alias("_at", "_word"))
        spots = spots.select("_id", "_at", F.inline(position_hashes(lengths))).where("key IS NOT NULL")
        # the rows that are dealt out hold two numbers and a position, never the text
        spots = spots.join(hashes, (F.col("key") == F.col("_key")) & (F.col("len") == F.col("_len")), "left_semi")
        places = spots.groupBy("_id").agg(F.collect_list(F.struct("_at", "len")).alias("_places"))
        found = cut.join(places, "_id", "left").select("_row", "_id", "_words", "_n", F.posexplode_outer("_places").alias("_i", "_p"))
        found = found.select("_row", "_id", "_words", "_n", F.col("_p._at").alias("_at"), F.col("_p.len").alias("_long"), F.col("_p").isNotNull().alias("_known"), "_i")
    known = F.coalesce("_known", F.lit(False))
    text = F.when(known, window_text(F.col("_words"), F.col("_at"), F.col("_long")))
    once = F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_row"))  # the other columns travel with the first row of a text
    return found.select(once.alias("_row"), "_id", "_n", F.when(known, F.col("_at")).alias("_at"), F.when(known, F.col("_long")).alias("_long"), text.alias("_text"))


def find_hits(docs: DataFrame, text: str, windows: DataFrame, keep: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_words`` and ``hits``: (start, length, items) of each matching window.

    Rows are kept apart even if they are equal.  ``keep`` names the columns to
    carry (default: all); a column called like an output is replaced.  A text
    that is null or has no words has no hits, and an empty ``windows`` gives
    none anywhere.  Hashes of windows beyond ``limit`` bytes are not broadcast.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "hits")]
    names = [f"c{i}" for i in range(len(keep))]
    limit = SET_LIMIT if limit is None else limit
    windows = written_once(windows, "windows")
    lengths = sorted(r[0] for r in windows.select("_len").distinct().collect()) or [1]  # at most n numbers
    cut = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.lit(0).alias("_")).alias("_row"),
        F.monotonically_increasing_id().alias("_id"),
        normal_words(F.col(text)).alias("_words"),
    ).withColumn("_n", F.size("_words"))
    found = candidate_hits(cut, windows.select("_key", "_len").distinct(), lengths, limit)
    # the words themselves are compared here; a window's place in the table stands for it from now on
    texts = broadcast_if_small(windows.select(F.col("_window").alias("_w"), F.col("_len").alias("_l"), F.md5("_window").alias("_name")), limit)
    found = found.join(texts, (F.col("_text") == F.col("_w")) & (F.col("_long") == F.col("_l")), "left")
    hit = F.when(F.col("_name").isNotNull(), F.struct(F.col("_at").alias("start"), F.col("_long").alias("length"), F.col("_name").alias("name")))
    rows = found.groupBy("_id").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.max(F.col("_n").cast("bigint")).alias("n_words"), F.collect_list(hit).alias("_hits")
    )
    rows = written_once(rows, "hits")
    # items of the distinct windows of each text that has some
    held = rows.where(F.size("_hits") > 0).select("_id", F.explode(F.array_distinct(F.transform("_hits", lambda h: h["name"]))).alias("_name"))
    items = windows.select(F.md5("_window").alias("_name"), "_items").groupBy("_name").agg(F.flatten(F.collect_list("_items")).alias("_items"))
    held = held.join(broadcast_if_small(items, limit), "_name").groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_items"))).alias("_of"))
    rows = rows.join(held, "_id", "left")
    named = F.transform("_hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"), F.element_at("_of", h["name"]).alias("items")))
    hits = F.when(F.size("_hits") > 0, F.array_sort(named)).otherwise(F.array().cast("array<struct<start:int,length:int,items:array<string>>>"))
    return rows.select(*[F.col("_row").getField(n).alias(c) for c, n in zip(keep, names)], "n_words", hits.alias("hits"))


def covered_words(hits: Column) -> Column:
    """Words inside at least one hit; overlapping hits count once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words"))

    def add(acc: Column, h: Column) -> Column:
        end = h.start + h.length
        fresh = F.greatest(end - F.greatest(h.start, acc.end), F.lit(0))
        return F.struct(F.greatest(acc.end, end).alias("end"), (acc.words + fresh).alias("words"))

    return F.aggregate(hits, start, add, lambda acc: acc.words)


def hit_items(hits: Column) -> Column:
    """Ids of the items with a hit, as sorted strings."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))


def without_hits(text: Column, hits: Column) -> Column:
    """The text without the words of any hit and the separators before them."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    other = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(text, F.lit(f"{other}*{word}|{other}+$"), F.lit(0))
    inside = lambda i: F.exists(hits, lambda h: (i >= h.start) & (i < h.start + h.length))
    return F.array_join(F.filter(pieces, lambda p, i: ~inside(i)), "")


def remove_spans(docs: DataFrame, text: str, windows: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, whatever they are called, with every hit cut out of the text."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    held = names[docs.columns.index(text)]
    found = find_hits(docs.toDF(*names), held, windows)
    clean = F.when(F.size("hits") > 0, without_hits(F.col(held), F.col("hits"))).otherwise(F.col(held))
    return found.withColumn(held, clean).select(*names).toDF(*docs.columns)


def remove_documents(docs: DataFrame, key: str, text: str, windows: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any hit, all columns; the texts are not shuffled while the hits are few.

    Each row is judged by its own text, also where rows share a key or have none.
    """
    name = free_name(docs.columns, "_digest")
    marked = docs.withColumn(name, digest_of(F.col(f"`{text}`")))
    hit = find_hits(marked, text, windows, [key, name]).where(F.size("hits") > 0)
    return join_rows(marked, [key, name], hit.select(f"`{key}`", name).distinct(), "left_anti").drop(name)
