"""Requests of the pairwise ranker packed into blocks that a step reads without moving a row.

The rows of a request lie in one block, in the order of their labels, as they
were given: a block is centred again in every step, because given values take
far less disk than centred ones.  Rows move once, when they are packed.
Requests too large for a block are found by counting and stay outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.chunks import stored
from rankloom.operators.sizing import ROW_OVERHEAD

#: bytes of rows in a block, and of the largest request that lies in one
BLOCK_BYTES, REQUEST_BYTES = 1 << 18, 8 << 20
#: estimated bytes of rows that one task sorts and packs
PACKING_SHARE = 32 << 20
#: requests are counted by hash before any is counted by itself
BUCKETS = 1 << 16


def large_requests(rows: DataFrame, group: str, most: int, path: str) -> tuple[DataFrame | None, int]:
    """(requests of more than ``most`` rows, if there are any, stored at ``path``; number of all rows).

    Only a bucket of more than ``most`` rows can hold such a request, so no other is counted by request.
    """
    spark = rows.sparkSession
    bucketed = rows.select(group, F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("int").alias("_bucket"))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    full, total = [(r["_bucket"],) for r in counts if r["n"] > most], sum(r["n"] for r in counts)
    if not full:
        return None, total
    near = bucketed.join(F.broadcast(spark.createDataFrame(full, "_bucket int")), "_bucket", "left_semi")
    found = near.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(group)
    found = stored(found, path)
    return (None if found.isEmpty() else found), total


def packing_parts(rows: DataFrame, total: int, width: int) -> int:
    """Tasks of a bounded size, and no fewer than can run at once."""
    measured = total * (ROW_OVERHEAD + 8 * (width + 2))
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-measured // PACKING_SHARE))


def request_weights(sizes: np.ndarray, y: np.ndarray, graded: np.ndarray, max_position: int) -> np.ndarray:
    """Ideal DCG of each request; its rows lie by rising label, those without a label first."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    position = ends - np.arange(len(y))
    worth = np.where(graded & (position <= max_position), (2.0**y - 1.0) / np.log2(position + 1.0), 0.0)
    return np.add.reduceat(worth, np.cumsum(sizes) - sizes)


def packed(rows: DataFrame, group: str, label: str, features: str, width: int, max_position: int, parts: int) -> DataFrame:
    """One row for each block: rows of each request, 1 / ideal DCG of each, which rows have a label, and label and
    features column by column.  Requests without a gain are left out, as no pair of theirs has a weight."""
    step = max(1, BLOCK_BYTES // (8 * (width + 1)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(label))
    ordered = rows.repartition(parts, group).select(place.alias("_place"), label, features)

    def block(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        first, graded, data = (np.concatenate(c) for c in zip(*held))
        sizes = np.diff(np.append(np.flatnonzero(first), len(first)))
        ideal = request_weights(sizes, data[:, 0], graded, max_position)
        kept = ~(ideal <= 0)
        if kept.any():
            of_row = np.repeat(kept, sizes)
            values = [
                sizes[kept].astype(np.int32).tobytes(),
                (1.0 / ideal[kept]).tobytes(),
                np.packbits(graded[of_row]).tobytes(),
                data[of_row].tobytes(order="F"),
            ]
            names = ["sizes", "each", "graded", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            place, y, x = batch.columns
            data = np.column_stack([y.fill_null(0.0).to_numpy(), x.flatten().to_numpy().reshape(-1, width)])
            first, graded = place.to_numpy() == 1, y.is_valid().to_numpy(zero_copy_only=False)
            starts, at = np.flatnonzero(first), 0
            while True:
                # a block ends where a request begins
                next_start = np.searchsorted(starts, at + max(0, step - n))
                to = starts[next_start] if next_start < len(starts) else len(data)
                if to > at:
                    held.append((first[at:to], graded[at:to], data[at:to]))
                    n += to - at
                if next_start == len(starts):
                    break
                yield from block(held)
                held, n, at = [], 0, to
        if n:
            yield from block(held)

    return ordered.mapInArrow(pack, "sizes binary, each binary, graded binary, data binary")


def block_sums(sizes: np.ndarray, each: np.ndarray, graded: np.ndarray, data: np.ndarray, scales: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss of all pairs of a block's requests, then its gradient; rows without a label count as a level below all others."""
    y, x, starts = data[:, 0], data[:, 1:], np.cumsum(sizes) - sizes
    with np.errstate(all="ignore"):
        means = np.add.reduceat(x, starts) / sizes[:, None]
        z = (x - np.repeat(means, sizes, axis=0)) / scales
        s = z @ w
        down, up = np.exp(-s), np.exp(s)
        opens = np.zeros(len(y), dtype=bool)
        opens[starts] = True
        opens[1:] |= (y[1:] != y[:-1]) | (graded[1:] != graded[:-1])
        levels = np.flatnonzero(opens)
        a, b = np.add.reduceat(down, levels), np.add.reduceat(up, levels)
        pulled, pushed = np.add.reduceat(z * down[:, None], levels), np.add.reduceat(z * up[:, None], levels)
        gain = np.where(graded[levels], 2.0 ** y[levels] - 1.0, 0.0)
        below, above = np.zeros(len(levels)), np.zeros(len(levels))
        first = np.searchsorted(levels, starts)
        depth = np.diff(np.append(first, len(levels)))
        # requests with the same number of levels are summed side by side
        for d in np.unique(depth[depth > 1]):
            at = first[depth == d][:, None] + np.arange(d)
            g, ga, gb = gain[at], gain[at] * a[at], gain[at] * b[at]
            under = lambda v: np.cumsum(v[:, :-1], axis=1)
            over = lambda v: np.cumsum(v[:, :0:-1], axis=1)[:, ::-1]
            below[at[:, 1:]] = g[:, 1:] * under(b[at]) - under(gb)
            above[at[:, :-1]] = over(ga) - g[:, :-1] * over(a[at])
        weight = np.repeat(each, depth) * graded[levels]
        pull, push = np.maximum(below, 0.0) * weight, np.maximum(above, 0.0) * weight
        return np.concatenate([[a @ pull], push @ pushed - pull @ pulled])


def summed(blocks: DataFrame, scales: np.ndarray, w: np.ndarray) -> DataFrame:
    """(loss, g0, g1, ...) of the blocks of each task."""
    width = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            for sizes, each, graded, data in zip(*batch.columns):
                rows = np.frombuffer(data.as_buffer()).reshape(width + 1, -1).T
                known = np.unpackbits(np.frombuffer(graded.as_buffer(), np.uint8), count=len(rows)).astype(bool)
                total += block_sums(np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(each.as_buffer()), known, rows, scales, w)
        names = ["loss", *[f"g{i}" for i in range(width)]]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    return blocks.mapInArrow(run, ", ".join(["loss double", *[f"g{i} double" for i in range(width)]]))
