"""Removing passages that an earlier document holds, by suffix automata of reference shards.

A window is ``window`` consecutive words.  A word goes if any window over it
also starts in a document with a lesser id.  The reference is the corpus
itself, so it is cut up before any automaton is built:

* A window's key is the least hash of its runs of ``GRAM`` words.  Equal
  windows have equal keys, and neighbouring windows mostly share theirs, so a
  text falls into slices: runs of windows with one key.  Only keys that two ids
  hold matter; texts without any are done.
* Equal slices become one, with the least and greatest id that holds it.
  The slices of a key go to the shard of that key, each shard a bounded number
  of words.  A key with many different slices (a common line amid different
  texts) is dissolved: its windows become slices of their own, those that one
  id alone holds drop out, and the rest are dealt by all their words.
* Each shard makes one suffix automaton of the stretches that more than one id
  may hold; its states know the least id that holds their strings.  While all
  automata are small by their proven bound they are broadcast and the slices
  stream past them; beyond that, the slices of a shard stream past its automaton
  in the task that has built it.  Matching statistics tell for each place how
  long the longest known string is that ends there; where that is a window or
  more, the state's id says whether the window's words go.

The keys only decide what is compared; the automaton decides what is equal.
Words stand for themselves as hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.automaton import Automaton, build, window_ranks
from rankloom.llm.common import digest_of, join_rows, python_workers
from rankloom.llm.near_duplicates import BASE, mix, power_table, text_batches
from rankloom.operators.chunks import written_once
from rankloom.operators.sizing import broadcast_if_small
from rankloom.session import shuffle_width

WINDOW, GRAM = 50, 16
#: windows in a slice; words of the slices in a shard; different slices of a key that stay together, about as many as fill a shard
LONGEST, SHARD_WORDS, HOT = 64, 1 << 16, 1024
#: bytes of keys, of automata and of spans that are broadcast
BROADCAST_BYTES, SPAN_BYTES = 64 << 20, 64 << 20
#: what a word takes in an automaton at most (two states, three transitions, a code); usual bytes of a word and its space
AUTOMATON_BYTES, WORD_SIZE = 76, 6
#: sequences that are matched together
TOGETHER = 4096

WORD_BYTES = np.arange(1, 257, dtype=np.uint64)
WORD_BYTES[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0


def word_codes(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of all words between white space of ASCII, the number of words of each text, all texts in a row,
    and where in them each word begins and ends."""
    parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
    joined = b" ".join(parts) + b" "
    raw = WORD_BYTES[np.frombuffer(joined, np.uint8)]
    up, down = power_table(len(raw) + 1)
    inside = raw != 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)])
    codes = mix((sums[last] - sums[first]) * down[first])
    ends = np.cumsum([len(p) + 1 for p in parts])
    return codes, np.diff(np.searchsorted(first, ends), prepend=0), joined, first, last


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` numbers from each place on."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    up, down = power_table(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * down[: len(codes) - size + 1] ^ np.uint64(BASE))


def window_keys(codes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word within all ``codes``, key) of every window that lies in one text."""
    gram = min(GRAM, window)
    least = gram_hashes(codes, gram)
    width, have = window - gram + 1, 1
    while have < width:  # the least of 1, 2, 4, ... hashes, then of two stretches that overlap
        move = min(have, width - have)
        least = np.minimum(least[:-move], least[move:]) if len(least) > move else least[:0]
        have += move
    number = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(text)) - (np.cumsum(number) - number)[text] + (np.cumsum(counts) - counts)[text]
    return text, at, least[at].view(np.int64)


def text_keys(docs: DataFrame, window: int) -> DataFrame:
    """(id, digest, key): the keys of the texts of rows (id, digest, text), one for each slice."""
    kind = dict(docs.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 2):
            text, _, key = window_keys(*word_codes(texts)[:2], window)
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            rows = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(key[new])], ["id", "digest", "key"])

    return docs.select("id", "digest", "text").mapInArrow(work, f"id {kind}, digest binary, key bigint")


def cut_slices(docs: DataFrame, window: int, keys: np.ndarray | None) -> DataFrame:
    """(id, digest, start, key, slice, piece) of all slices with wanted keys of rows (id, digest, text).

    ``keys`` are the wanted keys, sorted; without them rows have theirs in a
    column ``keys``.  ``start`` counts words of the text, ``piece`` is the text
    of the slice and ``slice`` a digest of key and piece.
    """
    kind = dict(docs.dtypes)["id"]
    sent = None if keys is None else docs.sparkSession.sparkContext.broadcast(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 2):
            codes, counts, raw, first, last = word_codes(texts)
            text, at, key = window_keys(codes, counts, window)
            # keys that another text of the batch wants do no harm
            wanted = sent.value if sent else np.unique(part.column(3).flatten().to_numpy())
            spot = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
            held = np.flatnonzero(wanted[spot] == key) if len(wanted) else np.empty(0, np.int64)
            text, at, key = text[held], at[held], key[held]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
            run = np.flatnonzero(new)
            spot = np.arange(len(text)) - np.repeat(run, np.diff(np.append(run, len(text))))
            begin = np.flatnonzero(spot % LONGEST == 0)
            end = np.append(begin[1:], len(text))[: len(begin)] - 1
            pieces = [raw[a:b] for a, b in zip(first[at[begin]].tolist(), last[at[end] + window - 1].tolist())]
            names = [hashlib.blake2b(k + p, digest_size=16).digest() for k, p in zip(key[begin].astype("<i8").view("S8").tolist(), pieces)]
            rows = pa.array(text[begin])
            start = at[begin] - (np.cumsum(counts) - counts)[text[begin]]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(start), pa.array(key[begin]), pa.array(names, pa.binary()), pa.array(pieces, pa.binary())],
                ["id", "digest", "start", "key", "slice", "piece"],
            )

    names = ["id", "digest", "text"] + ([] if sent else ["keys"])
    return docs.select(*names).mapInArrow(work, f"id {kind}, digest binary, start bigint, key bigint, slice binary, piece binary")


def slice_windows(slices: DataFrame, window: int) -> DataFrame:
    """(slice, low, high, at, name): every window of slices (slice, low, high, piece), named by a digest of its words."""
    kind = dict(slices.dtypes)["low"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, names = [], [], []
            for i, piece in enumerate(batch.column(3).to_pylist()):
                words = piece.split()
                for at in range(len(words) - window + 1):
                    rows.append(i)
                    ats.append(at)
                    names.append(hashlib.blake2b(b" ".join(words[at : at + window]), digest_size=16).digest())
            some = batch.select(["slice", "low", "high"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ats, pa.int64()), pa.array(names, pa.binary())], ["slice", "low", "high", "at", "name"])

    return slices.select("slice", "low", "high", "piece").mapInArrow(work, f"slice binary, low {kind}, high {kind}, at bigint, name binary")


def window_pieces(rows: DataFrame, window: int) -> DataFrame:
    """(name, low, high, piece): the words of one window each of rows (name, low, high, at, piece)."""
    kind = dict(rows.dtypes)["low"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [b" ".join(p.split()[a : a + window]) for p, a in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pieces, pa.binary())], ["name", "low", "high", "piece"])

    return rows.select("name", "low", "high", "at", "piece").mapInArrow(work, f"name binary, low {kind}, high {kind}, piece binary")


def shared_stretches(sequences: list[np.ndarray], low: np.ndarray, high: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(sequence, from, to) of the words whose windows more than one id may hold, each window once, where its least id is.

    ``low`` and ``high`` rank the ids of each sequence.  Windows are told apart
    by hashes here; a chance meeting only puts more into the automaton.
    """
    counts = np.array([len(s) for s in sequences], np.int64)
    codes = np.concatenate(sequences)
    number = np.maximum(counts - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(row)) - (np.cumsum(number) - number)[row]
    name = gram_hashes(codes, window)[at + (np.cumsum(counts) - counts)[row]]
    order = np.lexsort((at, row, low[row], name))
    name, row, at = name[order], row[order], at[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    first = np.flatnonzero(new)
    most = np.maximum.reduceat(high[row], first) if len(first) else first
    chosen = first[low[row[first]] < most]
    row, at = row[chosen], at[chosen]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row))[: len(begin)] - 1
    return list(zip(row[begin].tolist(), at[begin].tolist(), (at[end] + window).tolist()))


def shard_automaton(rows: pa.Table, window: int) -> tuple[Automaton, pa.Array, list[np.ndarray]]:
    """The automaton of a shard's units (low, high, piece), the ids its ranks stand for, and the units' words."""
    lows, highs = (rows.column(c).combine_chunks() for c in ("low", "high"))
    names = pa.concat_arrays([lows, highs]).unique()
    names = names.take(pc.sort_indices(names))
    low, high = (pc.index_in(c, names).to_numpy(False).astype(np.int64) for c in (lows, highs))
    sequences = split_codes(rows.column("piece").to_pylist())
    held = shared_stretches(sequences, low, high, window)
    return build([sequences[i][a:b] for i, a, b in held], [int(low[i]) for i, _, _ in held], window), names, sequences


def split_codes(pieces: list[bytes]) -> list[np.ndarray]:
    codes, counts, *_ = word_codes(pieces)
    return np.split(codes, np.cumsum(counts)[:-1])


def shard_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The shards of sorted batches, one after the other; the first column is the shard's number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy(False)
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                if held and held[0].column(0)[0].as_py() != shard[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def unit_runs(automaton: Automaton, lows: pa.Array, names: pa.Array, words: list[np.ndarray], window: int) -> Iterator[pa.RecordBatch]:
    """(unit, runs): for each unit the stretches of its windows that the automaton knows, with the least id that holds them."""
    for begin in range(0, len(words), TOGETHER):
        some = words[begin : begin + TOGETHER]
        rank = window_ranks(automaton, some, window)[:, window - 1 :]
        row, at = np.nonzero(rank >= 0)
        held = rank[row, at]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (held[1:] != held[:-1])
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(row))[: len(start)] - 1
        runs = pa.StructArray.from_arrays(
            [pa.array(at[start].astype(np.int64)), pa.array(at[last].astype(np.int64) + 1), lows.take(pa.array(held[start]))], ["from", "to", "low"]
        )
        offsets = pa.array(np.searchsorted(row[start], np.arange(len(some) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([names.slice(begin, TOGETHER), pa.ListArray.from_arrays(offsets, runs)], ["unit", "runs"])


def streamed(units: DataFrame, shards: int, window: int, broadcast: bool) -> DataFrame:
    """(unit, runs) of units (shard, unit, low, high, piece) matched with the automaton of their shard.

    ``broadcast``: the automata are collected and sent to all tasks, through
    which the units then pass as they lie.  Otherwise each passes in the task
    that has built its shard's automaton.
    """
    spark = units.sparkSession
    kind = dict(units.dtypes)["low"]
    schema = f"unit binary, runs array<struct<from:bigint,to:bigint,low:{kind}>>"
    tasks = min(shards, 16 * shuffle_width(spark))
    dealt = units.select("shard", "low", "high", "piece", "unit").repartition(tasks, "shard").sortWithinPartitions("shard")
    if not broadcast:

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in shard_tables(batches):
                automaton, lows, words = shard_automaton(rows, window)
                yield from unit_runs(automaton, lows, rows.column("unit").combine_chunks(), words, window)

        return dealt.mapInArrow(beside, schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shard_tables(batches):
            automaton, lows, _ = shard_automaton(rows, window)
            offsets = pa.array([0, len(lows)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).combine_chunks().slice(0, 1), pa.array([automaton.pack()], pa.binary()), pa.ListArray.from_arrays(offsets, lows)], ["shard", "automaton", "lows"]
            )

    rows = dealt.mapInArrow(packed, f"shard int, automaton binary, lows array<{kind}>").toArrow()
    lows_type = rows.schema.field("lows").type.value_type
    sent = spark.sparkContext.broadcast({n: (a, lows) for n, a, lows in zip(*(rows[c].to_pylist() for c in rows.column_names))})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, tuple[Automaton, pa.Array]] = {}
        for batch in batches:
            shard = batch.column(0).to_numpy(False)
            for n in np.unique(shard).tolist():
                if n not in ready:
                    raw, lows = sent.value[n]
                    ready[n] = (Automaton.unpack(raw), pa.array(lows, lows_type))
                part = batch.filter(pa.array(shard == n))
                yield from unit_runs(*ready[n], part.column(1), split_codes(part.column(2).to_pylist()), window)

    return units.select("shard", "unit", "piece").mapInArrow(work, schema)


def wanted_slices(rows: DataFrame, window: int, limit: int) -> DataFrame:
    """``cut_slices`` of all keys that more than one id holds.

    The keys are broadcast while they measure at most ``limit`` bytes; more of
    them are joined to the rows.
    """
    spots = text_keys(rows, window)
    shared = spots.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    shared = written_once(shared, "shared")
    if 8 * shared.count() <= limit:
        return cut_slices(rows, window, np.sort(shared.toArrow().column("key").to_numpy()))
    wanted = spots.join(shared, "key", "left_semi").groupBy("id", "digest").agg(F.collect_set("key").alias("keys"))
    return cut_slices(rows.join(wanted, ["id", "digest"]), window, None)


def repeated_spans(rows: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, digest, spans) of the rows (id, digest, text) with words to be removed.

    ``spans`` are the distinct (from, to) of such words, to exclusive; they may overlap.
    """
    cuts = written_once(wanted_slices(rows.where("id is not null"), window, limit), "cuts")
    slices = cuts.groupBy("slice").agg(
        F.first("key").alias("key"), F.first("piece").alias("piece"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    slices = written_once(slices, "slices")
    many = slices.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > hot).select("key")

    # a key with many slices: single windows, of which those of one id drop out
    crowded = slices.join(many, "key", "left_semi")
    windows = slice_windows(crowded, window)
    again = windows.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("slice", "at")).alias("one"))
    again = again.where("low < high").select("name", "low", "high", "one.slice", "one.at")
    again = window_pieces(again.join(crowded.select("slice", "piece"), "slice"), window)
    again = again.select(F.col("name").alias("unit"), F.xxhash64("name").alias("deal"), "low", "high", "piece")
    plain = slices.join(many, "key", "left_anti").select(F.col("slice").alias("unit"), F.xxhash64("key").alias("deal"), "low", "high", "piece")
    # a word is two bytes or more with the space after it
    words = slices.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = int(words) // (WORD_SIZE * shard_words) + 1
    units = plain.unionByName(again).withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int"))
    known = streamed(units, shards, window, (words // 2 + 1) * AUTOMATON_BYTES <= limit)
    known = written_once(known.where(F.size("runs") > 0), "known")

    single = windows.join(known.select(F.col("unit").alias("name"), "runs"), "name")
    single = single.select("slice", F.col("at").alias("from"), (F.col("at") + 1).alias("to"), F.element_at("runs", 1)["low"].alias("low"))
    single = single.groupBy("slice").agg(F.collect_list(F.struct("from", "to", "low")).alias("runs"))
    whole = known.select(F.col("unit").alias("slice"), "runs").unionByName(single)
    found = cuts.select("id", "digest", "start", "slice").join(whole, "slice")
    found = found.withColumn("r", F.explode(F.filter("runs", lambda r: r["low"] < F.col("id"))))
    span = F.struct((F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to") + window - 1).alias("to"))
    return written_once(found.groupBy("id", "digest").agg(F.collect_set(span).alias("spans")), "spans")


def with_repeats(docs: DataFrame, key: str, text: str, keep: list[str], window: int = WINDOW, **limits: int) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then n_words, n_removed and kept.

    ``kept`` holds the words that stay, joined by one space.  Windows are judged
    on the texts as they come, not on what is left.  A null text, or one
    without words, has none.  A null id is neither less nor greater than any:
    its row loses nothing and removes nothing.  Rows that share an id remove
    nothing from each other; equal rows stay apart.  A column of ``keep`` that
    is called like an output is refused.
    """
    out = ("n_words", "n_removed", "kept")
    clash = [c for c in keep if c.lower() in out]
    if clash:
        raise ValueError(f"columns called like an output: {clash}")
    python_workers(docs.sparkSession)
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.struct(*held, F.lit(0).alias("_")).alias("row"),
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        digest_of(F.col(f"`{text}`")).alias("digest"),
    )
    spans = broadcast_if_small(repeated_spans(rows.select("id", "digest", "text"), window, **limits), SPAN_BYTES)
    rows = join_rows(rows, ["id", "digest"], spans, "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 1):
            total, gone, kept = [], [], []
            for one, cut in zip(texts, part.column(2).to_pylist()):
                words = (one or "").encode("utf-8", "replace").split()
                total.append(len(words))
                if cut:
                    ends = np.array([(s["from"], s["to"]) for s in cut])
                    edge = np.bincount(ends[:, 0], minlength=len(words) + 1) - np.bincount(ends[:, 1], minlength=len(words) + 1)
                    stays = np.flatnonzero(np.cumsum(edge)[: len(words)] == 0)
                    words = [words[i] for i in stays.tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", *out]
            )

    kind = rows.schema["row"].dataType.simpleString()
    found = rows.select("row", "text", "spans").mapInArrow(work, f"row {kind}, n_words bigint, n_removed bigint, kept string")
    return found.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(keep)], *out)


def remove_repeats(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``; a text that loses words keeps the others, joined by one space.

    Other texts stay as they are, nulls included.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    id_, held = (names[docs.columns.index(c)] for c in (key, text))
    found = with_repeats(docs.toDF(*names), id_, held, names, window)
    clean = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(held))
    return found.withColumn(held, clean).select(*names).toDF(*docs.columns)
