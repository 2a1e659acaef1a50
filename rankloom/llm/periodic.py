"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q, at least four periods and
six words long, that neither neighbour continues.  For the periods in [b, 2b),
b a power of two, such a stretch holds a whole aligned block of b words that
occurs again q words later, so inside the next two blocks.  The words of a text
are numbered; for every block and distance the sum of squared differences,

    sum B^2 + sum Y^2 - 2 * correlation(B, Y),

is made by a number-theoretic transform modulo a prime, in whole numbers.  A
sum that is zero makes (block, distance) a seed.  Blocks are transformed once:
a window's transform is that of its first block plus, in every second place
minus, that of its second.  Seeds are extended to both sides with hashed
prefixes and binary steps, and every run that comes out is compared word by
word.  Differences that only vanish modulo the prime, or hashes that agree by
chance, therefore add nothing, and no zero is ever missed.

Texts are cut, numbered and convolved in batches of bounded size inside Arrow
workers; the job is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import python_workers
from rankloom.llm.near_duplicates import BASE, mix, power_table, text_batches

#: a run has at least so many periods and so many words
PERIODS, LEAST = 4, 6
#: 15 * 2^27 + 1, with a root of unity for every power of two up to 2^27
PRIME, ROOT = 2013265921, 31
#: numbers in the matrix of blocks that is transformed at once
CELLS = 1 << 20

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


@cache
def roots(size: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Factors of each level of the transform and of its inverse, and where the negative of each index stands.

    The forward transform leaves its numbers in bit-reversed order, which is
    what the inverse takes.
    """
    forward, backward = [], []
    width = size
    while width > 1:
        for held, root in ((forward, ROOT), (backward, pow(ROOT, -1, PRIME))):
            step = pow(root, (PRIME - 1) // width, PRIME)
            factors = np.ones(1, np.uint64)
            power = step
            while len(factors) < width // 2:  # doubling: w^(m+i) = w^m * w^i
                factors = np.concatenate([factors, factors * np.uint64(power) % np.uint64(PRIME)])
                power = power * power % PRIME
            held.append(factors[: max(width // 2, 1)])
        width //= 2
    order = np.zeros(1, np.int64)
    while len(order) < size:
        order = np.concatenate([order * 2, order * 2 + 1])
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return forward, backward[::-1], place[-order % size]


def transform(rows: np.ndarray) -> np.ndarray:
    """Transform of every row (natural order in, bit-reversed order out)."""
    p = np.uint64(PRIME)
    count, size = rows.shape
    for factors in roots(size)[0]:
        half = len(factors)
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        total = low + high
        out[:, :, 0] = np.where(total >= p, total - p, total)
        out[:, :, 1] = (low + (p - high)) * factors % p
        rows = out.reshape(count, size)
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """Inverse transform of every row (bit-reversed order in, natural order out)."""
    p = np.uint64(PRIME)
    count, size = rows.shape
    for factors in roots(size)[1]:
        half = len(factors)
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * factors % p
        out = np.empty_like(pairs)
        total = low + high
        out[:, :, 0] = np.where(total >= p, total - p, total)
        total = low + (p - high)
        out[:, :, 1] = np.where(total >= p, total - p, total)
        rows = out.reshape(count, size)
    return rows * np.uint64(pow(size, -1, PRIME)) % p


def seeds(codes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of all blocks of ``block`` words that occur again ``block`` to 2 * ``block`` - 1 words later.

    ``codes`` are numbers under the prime; its last 2 * ``block`` or more are found once only.
    """
    p = np.uint64(PRIME)
    number = len(codes) // block - 2
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * codes % p, dtype=np.uint64)])
    step = max(1, CELLS // (2 * block))
    negative = roots(2 * block)[2]
    places, distances = [], []
    for first in range(0, number, step):
        last = min(first + step, number)
        rows = np.zeros((last - first + 2, 2 * block), np.uint64)
        rows[:, :block] = codes[first * block : (last + 2) * block].reshape(-1, block)
        rows = transform(rows)
        window = rows[1:-1].copy()
        window[:, :block] += rows[2:, :block]
        window[:, block:] += p - rows[2:, block:]
        shared = inverse(rows[:-2][:, negative] * (window % p) % p)[:, :block]
        at = np.arange(first, last)[:, None] * block
        near = at + block + np.arange(block)
        both = (squares[at + block] - squares[at]) + (squares[near + block] - squares[near])
        found = np.nonzero(both % p == 2 * shared % p)
        places.append((found[0] + first) * block)
        distances.append(found[1] + block)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


class Prefixes:
    """Hashes of all beginnings of a sequence, to tell how far two places agree."""

    def __init__(self, codes: np.ndarray) -> None:
        self.up = power_table(len(codes) + 1)[0]
        spread = mix(codes + np.uint64(BASE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * self.up[: len(codes)], dtype=np.uint64)])
        self.n = len(codes)

    def agree(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        one = self.sums[at + length] - self.sums[at]
        two = self.sums[at + distance + length] - self.sums[at + distance]
        return one * self.up[distance] == two

    def reach(self, at: np.ndarray, distance: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on, or before it, equal those ``distance`` later."""
        room = at if back else self.n - at - distance
        found = np.zeros_like(at)
        step = 1 << max(int(room.max(initial=0)).bit_length() - 1, 0)
        while step:
            fits = np.flatnonzero(found + step <= room)
            length = np.full(len(fits), step)
            start = at[fits] - found[fits] - step if back else at[fits] + found[fits]
            found[fits[self.agree(start, distance[fits], length)]] += step
            step //= 2
        return found


def exact_runs(codes: np.ndarray, period: int) -> list[tuple[int, int]]:
    """(start, end) of all long enough stretches with this period, word by word."""
    same = np.concatenate([[False], codes[:-period] == codes[period:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] + period >= max(LEAST, PERIODS * period)]
    return [(int(s), int(e) + period) for s, e in edge]


def runs_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, sorted; texts end at ``ends`` and no run crosses an end.

    ``codes`` numbers equal words equally, from 0.
    """
    lengths = np.diff(ends, prepend=0)
    fresh = int(codes.max(initial=0)) + 1
    runs = np.empty((0, 3), np.int64)
    block = 1
    while block * PERIODS <= lengths.max(initial=0):
        # texts that can hold such a period, each followed by a number of its own
        chosen = np.flatnonzero(lengths >= max(LEAST, PERIODS * block))
        sizes = lengths[chosen]
        if not len(chosen):
            break
        starts = np.cumsum(sizes + 1) - sizes - 1
        shift = (ends[chosen] - sizes) - starts  # from a place in the chosen texts to that in all
        total = int(sizes.sum()) + len(sizes)
        padded = fresh + np.arange(-(-total // block) * block + 2 * block, dtype=np.uint64)
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(chosen)), sizes)
        padded[at] = codes[at + np.repeat(shift, sizes)]
        at, distance = seeds(padded, block)
        if len(runs):
            # a block and its copy inside a run of a shorter period: the distance is a multiple of that period, nothing new
            place = at + shift[np.searchsorted(starts, at, "right") - 1]
            far = np.maximum.accumulate(runs[:, 1])
            left = np.searchsorted(runs[:, 0], place, "right") - 1
            new = (left < 0) | (far[left] < place + distance + block)
            at, distance = at[new], distance[new]
        prefixes = Prefixes(padded)
        start = at - prefixes.reach(at, distance, True)
        end = at + distance + prefixes.reach(at, distance, False)
        held = end - start >= np.maximum(LEAST, PERIODS * distance)
        rows = np.unique(np.stack([start, end, distance], axis=1)[held], axis=0)
        rows[:, :2] += shift[np.searchsorted(starts, rows[:, 0], "right") - 1][:, None]
        runs = np.unique(np.concatenate([runs, rows]), axis=0)
        # of the periods of one stretch the least is its own
        first = np.ones(len(runs), bool)
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[first]
        block *= 2
    for s, e, q in runs.tolist():
        if not np.array_equal(codes[s : e - q], codes[s + q : e]):  # two hashes met by chance: all texts word by word
            return np.array(sorted(slow_runs(codes, ends)), np.int64).reshape(-1, 3)
    return runs


def slow_runs(codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """What ``runs_of`` gives, period by period."""
    out = []
    for first, last in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        seen: set[tuple[int, int]] = set()
        for period in range(1, (last - first) // PERIODS + 1):
            for s, e in exact_runs(codes[first:last], period):
                if (s, e) not in seen:
                    seen.add((s, e))
                    out.append((first + s, first + e, period))
    return out


def batch_words(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words between white space of ASCII of each text, the number of each word, and where each text ends."""
    words = [(t or "").encode("utf-8", "replace").split() for t in texts]
    flat = pa.array([w for one in words for w in one], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy(False).astype(np.uint64)
    return words, codes, np.cumsum([len(w) for w in words], dtype=np.int64)


def with_runs(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then n_words, runs and collapsed.

    ``runs`` (start, length, period; words counted from 0) are sorted by start,
    then period.  ``collapsed`` is the text's words, joined by one space,
    without those that come after the first period of a run.  A null text, or
    one without words, has no runs and an empty ``collapsed``.  Equal rows stay
    apart; a column of ``keep`` that is called like an output is refused.
    """
    out = ("n_words", "runs", "collapsed")
    clash = [c for c in keep if c.lower() in out]
    if clash:
        raise ValueError(f"columns called like an output: {clash}")
    python_workers(docs.sparkSession)
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.struct(*held, F.lit(0).alias("_")).alias("_row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 0):
            words, codes, ends = batch_words(texts)
            rows = runs_of(codes, ends)
            which = np.searchsorted(ends, rows[:, 0], "right")
            starts = np.concatenate([[0], ends[:-1]])
            order = np.lexsort((rows[:, 2], rows[:, 0]))
            rows, which = rows[order], which[order]
            edges = np.searchsorted(which, np.arange(len(texts) + 1))
            kept = np.zeros(int(ends[-1]) + 1, np.int64)
            np.add.at(kept, rows[:, 0] + rows[:, 2], 1)
            np.add.at(kept, rows[:, 1], -1)
            stays = np.cumsum(kept) == 0
            collapsed = []
            for i, one in enumerate(words):
                if edges[i] == edges[i + 1]:
                    collapsed.append(b" ".join(one))
                else:
                    collapsed.append(b" ".join([one[j] for j in np.flatnonzero(stays[starts[i] : ends[i]]).tolist()]))
            lists = pa.ListArray.from_arrays(
                pa.array(edges, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(rows[:, 0] - starts[which]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"]
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(np.diff(ends, prepend=0)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["_row", "n_words", "runs", "collapsed"],
            )

    row_type = rows.schema["_row"].dataType.simpleString()
    found = rows.mapInArrow(work, f"_row {row_type}, n_words bigint, runs {RUN_TYPE}, collapsed string")
    return found.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(keep)], *out)


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first.  Null without runs."""
    better = lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a))


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    one = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(one(r), F.lit("\n"))), "")


def collapse_runs(docs: DataFrame, text: str) -> DataFrame:
    """All rows and columns of ``docs``; a text with runs keeps the first period of each, its words joined by one space.

    Other texts stay as they are, nulls included.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    held = names[docs.columns.index(text)]
    found = with_runs(docs.toDF(*names), held, names)
    clean = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(held))
    return found.withColumn(held, clean).select(*names).toDF(*docs.columns)
