"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams.  A bucket's gain is the logarithm of how
much likelier the target makes it than the corpus does; a text weighs the sum
of the gains of its features, and a draw without replacement takes the greatest
sums of weight and Gumbel noise.

The work on texts is made of array kernels: lower-casing, splitting, flattening
and dictionary encoding give every word a number; numbers shifted against each
other are the n-grams; each distinct pair (n-gram, next word) gets its checksum
from those of its two parts; gains are taken by bucket and summed by segment.
Counts leave a task as one row for each bucket; only the gains, one number for
each bucket, reach the driver and the tasks of the second scan.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import digest_of, free_name, join_rows, python_workers
from rankloom.llm.near_duplicates import text_batches
from rankloom.operators.chunks import number_rows, written_once

BUCKETS, LONGEST, SEED, LEAST_WORDS = 10_000, 3, 42, 20
#: everything in ASCII that is neither a digit nor a small letter
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: thousandths
UNIT = 1000


@cache
def shift_table(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of each byte of a checksum: four tables of 256."""
    if power:
        half = shift_table(power - 1)
        return shifted_by(shifted_by(np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None], half), half)
    single = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        single = np.where(single & 1, (single >> 1) ^ np.uint32(0xEDB88320), single >> 1)
    number = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return (number >> np.uint32(8)) ^ single[number & np.uint32(255)]


def shifted_by(sums: np.ndarray, tables: np.ndarray) -> np.ndarray:
    byte = lambda k: tables[k][(sums >> np.uint32(8 * k)) & np.uint32(255)]
    return byte(0) ^ byte(1) ^ byte(2) ^ byte(3)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from those of the parts and the second's ``length`` in bytes."""
    out = first.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        moved = np.flatnonzero((length >> power) & 1)
        out[moved] = shifted_by(out[moved], shift_table(power))
    return out ^ second


def features(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of n-gram the buckets of all n-grams and where each text's end."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=GAP)
    flat = pc.list_flatten(split)
    text = pc.list_parent_indices(split).to_numpy(False)
    full = pc.greater(pc.binary_length(flat), 0)
    flat, text = flat.filter(full), text[full.to_numpy(False)]
    counts = np.bincount(text, minlength=len(texts)).astype(np.int64)
    coded = flat.dictionary_encode()
    word = coded.indices.to_numpy(False).astype(np.int64)
    raw = coded.dictionary.cast(pa.binary()).to_pylist()
    alone = np.array([zlib.crc32(w) for w in raw], np.uint32)
    after = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in raw], np.uint32)
    width = np.array([len(w) + 1 for w in raw], np.int64)
    gram, crc = word, alone  # of each n-gram its number, of each number its checksum
    out = []
    for n in range(1, longest + 1):
        if n > 1:
            # an n-gram and the word after it, where both lie in one text
            fits = np.flatnonzero(text[: len(gram) - 1] == text[n - 1 :]) if len(gram) > 1 else np.empty(0, np.int64)
            pair = gram[:-1] * np.int64(len(raw)) + word[n - 1 :] if len(gram) > 1 else np.empty(0, np.int64)
            if len(pair):
                distinct = pa.array(pair).dictionary_encode()
                pairs = distinct.dictionary.to_numpy()
                left, right = pairs // len(raw), pairs % len(raw)
                crc = joined_crc(crc[left], after[right], width[right])
                gram = distinct.indices.to_numpy(False).astype(np.int64)
            else:
                gram, crc = np.empty(0, np.int64), np.empty(0, np.uint32)
            held = gram[fits]
        else:
            held = gram
        number = np.maximum(counts - n + 1, 0)
        out.append((np.take(crc % np.uint32(buckets), held).astype(np.int64), np.cumsum(number)))
    return counts, out


def bucket_counts(docs: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; buckets without any have no row."""
    python_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for part, _ in text_batches(batches, 0):
            for bucket, _ in features(part.column(0), buckets, longest)[1]:
                seen += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": held, "n": seen[held]})

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str, target_text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Gain of each bucket in thousandths; one is added to every count, so a bucket that nobody fills gains little or nothing."""
    held = []
    for docs, name in ((corpus, text), (target, target_text)):
        counts = np.zeros(buckets, np.int64)
        rows = bucket_counts(docs, name, buckets, longest).toArrow()  # at most one row for each bucket
        counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        held.append(counts)
    s, t = held
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(UNIT * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(seed: int, name: str) -> int:
    """Gumbel noise in thousandths, made from a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, key: str, text: str, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score and a ``digest`` of the text.

    A null text, or one without words, has no features and weight 0.  A null id
    draws its noise as an empty text.  Other columns are ignored.
    """
    python_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("name"),
        F.col(f"`{text}`").cast("string").alias("text"),
        digest_of(F.col(f"`{text}`")).alias("digest"),
    )
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part, _ in text_batches(batches, 2):
            counts, grams = features(part.column(2), len(table), longest)
            number, weight = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for bucket, ends in grams:
                sums = np.concatenate([[0], np.cumsum(np.take(table, bucket))])
                weight += np.diff(sums[ends], prepend=0)
                number += np.diff(ends, prepend=0)
            lots = np.array([noise(seed, name) for name in part.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(number), pa.array(weight), pa.array(weight + lots), part.column(3)],
                ["id", "n_words", "n_features", "weight", "score", "digest"],
            )

    return rows.mapInArrow(work, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, digest binary")


def ranked(rows: DataFrame, percent: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` of ``scored`` with their ``rank`` in the draw; null if not drawn.

    Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded
    down) are drawn: the greatest scores, ties by lesser id, null last, then by
    digest.  A range sort with numbers per partition; no task holds all rows.
    """
    rows = written_once(rows, "scored")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    order = [F.desc("score"), F.col("id").isNull(), F.col("id"), F.col("digest")]
    numbered = number_rows(rows.where(able), order, out="_at")
    numbered = numbered.withColumn("rank", F.when(F.col("_at") < drawn, F.col("_at").cast("bigint") + 1)).drop("_at")
    return numbered.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame,
    key: str,
    text: str,
    target: DataFrame,
    target_text: str,
    percent: int,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """The drawn rows of ``docs``, all columns.

    A row is drawn by its own key and text.  Rows that share both have one
    score; the draw counts them one by one and takes all of them with the first.
    An empty ``docs`` gives no rows; with an empty ``target`` all buckets have
    no features there and the draw prefers what is rare.
    """
    rows = scored(docs, key, text, gains(docs, target, text, target_text, buckets, longest), longest, seed)
    drawn = ranked(rows, percent, least_words).where("rank is not null").select("id", "digest").distinct()
    name = free_name(docs.columns, "_digest")
    marked = docs.withColumn(name, digest_of(F.col(f"`{text}`")))
    return join_rows(marked, [key, name], drawn, "left_semi").drop(name)
