"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

A document is the bag of its five-word shingles, each weighing its count times
an inverse document frequency.  Improved consistent weighted sampling draws
shingles so that two documents draw the same one with the probability of their
weighted Jaccard similarity; every band combines four draws, each over all
shingles, into one key, and documents that share a key become candidates.  Their
similarity is then computed from all their shingles.  Groups are the connected
components of the pairs at or above the threshold.

What keeps it bounded:

* Texts with the same words become one node before anything is compared.
* A bucket is first compared with one centre, the member that shares most
  buckets with others.  Buckets that are still in several components after that
  are divided by a second band; in each part, a member of the largest component
  drawn by lot is compared with those of other components.  This joins most of
  what belongs together with work linear in the members.
* What is still apart is then compared completely: all pairs of one bucket that
  lie in different components, in cells of two bounded blocks of members.  No
  row is made for a pair below the threshold.  First only the draws are
  compared; the shingles are sent only of members with a hopeful partner.
* Document frequencies come from a count-min sketch of fixed size over all
  documents.  Frequencies matter as shares of all documents, and the sketch's
  error is a share too, so it does not grow with the corpus.
* Components are found by rounds of joins on stored edges.

Nothing but the sketch reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import digest_of, free_name, join_rows, python_workers
from rankloom.llm.components import connected_components
from rankloom.operators.chunks import written_once
from rankloom.operators.sizing import broadcast_if_small

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: share of equal draws below which a pair is not worth the exact computation: four standard deviations under the threshold
HOPEFUL = 0.6
#: count-min sketch: rows and cells in a row; cells sent together
DEPTH, WIDTH_BITS, CELLS = 2, 18, 1024
#: a document frequency counts as a share of all documents, smoothed by this much
SMOOTH = 0.1
BATCH_BYTES = 1_000_000
#: bytes of draws or shingles in a block of members; members of a bucket are compared block by block
BLOCK_BYTES = 4 << 20
#: ids broadcast to pick out texts for the exact computation
ID_LIMIT = 32 << 20

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
ODD = [(0xD1B54A32D192ED03 * (2 * k + 1)) & M64 for k in range(SHINGLE)]
LETTERS = np.zeros(256, np.uint64)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        LETTERS[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, made longer when a batch needs it."""
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_table(n: int) -> list[np.ndarray]:
    held = powers()
    if len(held[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            held[i] = np.cumprod(steps, dtype=np.uint64)
    return held


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text.

    Words are runs of ASCII letters and digits, A-Z taken as a-z, and of
    everything beyond ASCII.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = LETTERS[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    up, down = power_table(len(raw) + 1)
    inside = raw != 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)])
    hashes = mix((sums[last] - sums[first]) * down[first])
    ends = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often), sorted by text and shingle.  A shorter text with words is one shingle."""
    number = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), number)
    first = np.cumsum(counts) - counts
    at = first[text] + np.arange(len(text)) - (np.cumsum(number) - number)[text]
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    value = np.zeros(len(text), np.uint64)
    for k in range(SHINGLE):
        word = padded[at + k] * np.uint64(ODD[k])
        value += np.where(k < counts[text], word, np.uint64(0)) if k else word
    value = mix(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(fresh)
    return text[starts], value[starts], np.diff(np.append(starts, len(text)))


def text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows and texts of bounded size; a single text may exceed it."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        groups = np.cumsum(sizes + 1) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                yield part, part.column(column).to_pylist()


def cells_of(values: np.ndarray) -> list[np.ndarray]:
    """The cell of each shingle in every row of the sketch."""
    shift = np.uint64(64 - WIDTH_BITS)
    return [((values * np.uint64(ODD[d])) >> shift).astype(np.int64) + (d << WIDTH_BITS) for d in range(DEPTH)]


def frequency_sketch(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Count-min sketch of the document frequencies of all shingles, and the number of documents with words."""
    size = DEPTH << WIDTH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, documents = np.zeros(size, np.int64), 0
        for _, texts in text_batches(batches, 0):
            hashes, counts = word_hashes(texts)
            _, value, _ = shingles(hashes, counts)
            for cells in cells_of(value):
                seen += np.bincount(cells, minlength=size)
            documents += int((counts > 0).sum())
        blocks = seen.reshape(-1, CELLS)
        yield pa.RecordBatch.from_pydict({"block": np.arange(len(blocks)), "cells": list(blocks), "documents": [documents] + [0] * (len(blocks) - 1)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        documents = 0
        for batch in batches:
            documents += sum(batch.column(2).to_pylist())
            cells = batch.column(1).values.to_numpy().reshape(-1, CELLS)
            for block, row in zip(batch.column(0).to_pylist(), cells):
                sums[block] = sums.get(block, 0) + row
        yield pa.RecordBatch.from_pydict(
            {"block": [-1, *sums], "cells": [np.array([documents]), *sums.values()], "documents": [0] * (len(sums) + 1)},
            pa.schema([("block", pa.int64()), ("cells", pa.list_(pa.int64())), ("documents", pa.int64())]),
        )

    schema = "block long, cells array<long>, documents long"
    parts = docs.select(F.col(f"`{text}`")).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    sketch, documents = np.zeros((size // CELLS, CELLS), np.int64), 0
    for block, cells in zip(*(c.to_pylist() for c in parts.toArrow().columns[:2])):
        if block < 0:
            documents += cells[0]
        else:
            sketch[block] += cells
    return sketch.ravel().astype(np.int32 if documents < 1 << 31 else np.int64), documents


def weights_of(value: np.ndarray, times: np.ndarray, sketch: np.ndarray, documents: int) -> np.ndarray:
    """TF-IDF: the count times 1 + ln((1 + s) / (share of documents + s))."""
    share = np.minimum.reduce([sketch[c] for c in cells_of(value)]) / max(documents, 1)
    return times * (1 + np.log((1 + SMOOTH) / (np.minimum(share, 1) + SMOOTH)))


@cache
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 fixed draws each: r from Gamma(2, 1), ln c with c from Gamma(2, 1), and b from the unit interval."""
    u = (mix(np.arange(1, 5 * 65536 + 1, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(11)).astype(np.float64).reshape(5, -1) / (1 << 53) + 1e-16
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


def samples(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Draws (text, band, row) as 32-bit numbers; ``text`` is sorted and every text has a shingle.

    Every draw is made over all shingles of the text: it is the shingle with
    the least a = c / (y e^r), together with its level t: ln y = r (t - b),
    t = floor(ln weight / r + b).
    """
    r_table, c_table, b_table = draws()
    starts = np.searchsorted(text, np.arange(texts))
    log_weight = np.log(weight)
    low = np.uint64(0xFFFF)
    out = np.empty((texts, BANDS, ROWS), np.uint32)
    for draw in range(BANDS * ROWS):
        bits = mix(value ^ np.uint64((BASE * (draw + 1)) & M64))
        r, b = r_table[bits & low], b_table[(bits >> np.uint64(16)) & low]
        level = np.floor(log_weight / r + b)
        log_a = (c_table[(bits >> np.uint64(32)) & low] - r * (level - b) - r).astype(np.float32)
        raw = log_a.view(np.uint32)
        ordered = np.where(raw >> 31, ~raw, raw | np.uint32(1 << 31)).astype(np.uint64)
        name = ((bits ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(ODD[1]))) * np.uint64(ODD[2])) >> np.uint64(32)
        out[:, draw // ROWS, draw % ROWS] = np.minimum.reduceat((ordered << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """One number for each text and band."""
    key = np.full(drawn.shape[:2], 1, np.uint64) * (np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for row in range(ROWS):
        key = mix(key ^ (drawn[:, :, row].astype(np.uint64) * np.uint64(ODD[3])))
    return key.view(np.int64)


def node_of(words: np.ndarray) -> bytes:
    """Name of a sequence of words: a digest of 16 bytes."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def node_batches(hashes: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(counts)
    return [node_of(hashes[e - n : e]) if n else None for e, n in zip(ends.tolist(), counts.tolist())]


def signatures(docs: DataFrame, key: str, text: str, sketch: np.ndarray, documents: int) -> DataFrame:
    """(id, digest, node, bands, drawn) of every row; a text without words has nulls."""
    sent = docs.sparkSession.sparkContext.broadcast((sketch, documents))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), digest_of(F.col(f"`{text}`")).alias("digest"))
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = sent.value
        for part, texts in text_batches(batches, 1):
            hashes, counts = word_hashes(texts)
            held = np.flatnonzero(counts)
            text_at, value, times = shingles(hashes, counts[held])
            bands: list = [None] * len(texts)
            drawn: list = [None] * len(texts)
            if len(held):
                found = samples(text_at, value, weights_of(value, times, table, n), len(held))
                small = (found & 0xFF).astype(np.uint8).reshape(len(held), -1)
                for i, keys, bytes_ in zip(held.tolist(), band_keys(found), small):
                    bands[i], drawn[i] = keys, bytes_.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(node_batches(hashes, counts), pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(drawn, pa.binary())],
                ["id", "digest", "node", "bands", "drawn"],
            )

    return rows.mapInArrow(work, f"id {kind}, digest binary, node binary, bands array<long>, drawn binary")


def hopeful(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose draws agree often enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = pairs.join(drawn.select(F.col("node").alias("a"), F.col("drawn").alias("da")), "a")
    rows = rows.join(drawn.select(F.col("node").alias("b"), F.col("drawn").alias("db")), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("da", "db"))
            keep = pa.array((one == two).mean(axis=1) >= HOPEFUL)
            yield batch.select(["a", "b"]).filter(keep)

    return rows.select("a", "b", "da", "db").mapInArrow(agree, "a binary, b binary")


def vectors(docs: DataFrame, key: str, text: str, nodes: DataFrame, sketch: np.ndarray, documents: int) -> DataFrame:
    """(node, shingles, weights) of the wanted ``nodes`` (node, id of a row with that text)."""
    sent = docs.sparkSession.sparkContext.broadcast((sketch, documents))
    wanted = broadcast_if_small(nodes.select("id").distinct(), ID_LIMIT)
    rows = join_rows(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), ["id"], wanted, "left_semi").select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = sent.value
        for _, texts in text_batches(batches, 0):
            hashes, counts = word_hashes(texts)
            at, value, times = shingles(hashes, counts)
            weight = weights_of(value, times, table, n)
            ends = np.searchsorted(at, np.arange(len(texts) + 1))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node_batches(hashes, counts), pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.float64))),
                ],
                ["node", "shingles", "weights"],
            )

    found = rows.mapInArrow(work, "node binary, shingles array<long>, weights array<double>")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights; shingles are distinct in either list."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[i], wb[j]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def verified(pairs: DataFrame, vectors: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) at or above the threshold, with their similarity."""
    side = lambda n: vectors.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"), F.col("weights").alias(f"w{n}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "wa", "sb", "wb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("sa", "wa", "sb", "wb")]
            found = [weighted_jaccard(*(x[i].values.to_numpy() for x in lists)) for i in range(batch.num_rows)]
            found = np.array(found)
            keep = found >= similar - 1e-12
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).filter(pa.array(keep)) for c in ("a", "b")), pa.array(found[keep], pa.float64())], ["a", "b", "similarity"]
            )

    return rows.mapInArrow(compare, "a binary, b binary, similarity double")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(bucket, last, node, score): the members of all buckets with two nodes or more; ``last`` is the band's number.

    A node's score is how many others it meets, over all its buckets.
    """
    rows = nodes.select("node", F.posexplode("bands").alias("last", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written_once(rows.join(sizes, "bucket"), "buckets")
    scores = rows.groupBy("node").agg(F.sum("size").alias("score"))
    return rows.join(scores, "node").select("bucket", "last", "node", "score")


def star_pairs(members: DataFrame, order: Column) -> DataFrame:
    """Each member of a bucket (bucket, node, label) with the one of greatest ``order``, where their labels differ."""
    centre = members.groupBy("bucket").agg(F.max(F.struct(order.alias("o"), "node", "label")).alias("_c"))
    centre = centre.select(F.col("bucket").alias("_b"), F.col("_c.node").alias("a"), F.col("_c.label").alias("_l"))
    rows = members.join(centre, (F.col("bucket") == F.col("_b")) & (F.col("label") != F.col("_l")))
    return rows.select("a", F.col("node").alias("b"))


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that lie in several components, with the ``label`` and size (``alike``) of theirs."""
    rows = members.join(labels, "node", "left").withColumns({"label": F.coalesce("label", "node"), "alike": F.coalesce("alike", F.lit(1))})
    several = rows.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("bucket")
    return rows.join(several, "bucket", "left_semi")


def sized_components(edges: DataFrame) -> DataFrame:
    """(node, label, alike): the component of each node and how many nodes it has."""
    labels = connected_components(edges)
    return labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("alike")), "label")


def divided(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The buckets divided by every later band: (bucket, node, label, alike)."""
    kept = members.select("bucket", F.col("last").alias("_last"), "node", "label", "alike").join(nodes.select("node", "bands"), "node")
    later = F.explode(F.slice("bands", F.col("_last") + 2, BANDS)).alias("_key")
    rows = kept.select("node", "label", "alike", "bucket", later)
    return rows.select(F.xxhash64("bucket", "_key").alias("bucket"), "node", "label", "alike")


def in_cells(members: DataFrame, size: Column) -> DataFrame:
    """Members of buckets dealt into blocks of about ``BLOCK_BYTES``, and each to all cells of two blocks that hold its own.

    ``part`` is the member's block, ``lo`` and ``hi`` are those of the cell: two
    members of a bucket meet in one cell, those of one block in the cell of
    that block alone.
    """
    blocks = members.groupBy("bucket").agg(F.ceil(F.sum(size) / BLOCK_BYTES).cast("int").alias("_blocks"))
    rows = members.join(blocks, "bucket").withColumn("part", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumns({"lo": F.least("part", "_other"), "hi": F.greatest("part", "_other")}).drop("_other", "_blocks")


def cell_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The cells of sorted batches, one after the other; the first three columns are bucket, lo and hi."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(i).to_numpy(False) for i in range(3)])
        edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and name != tuple(names[:, a]):
                yield pa.Table.from_batches(held)
                held = []
            name = tuple(names[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def labels_in(cell: pa.Table) -> np.ndarray:
    """Numbers of the components of a cell's members."""
    return np.unique(np.array(cell.column("label").to_pylist(), object), return_inverse=True)[1]


def partners(cell: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a cell with those it is to be compared with.

    These have another ``label`` (read anew for each member) and, in a cell of
    two blocks, lie in the other block; they share no earlier bucket with the
    member and have enough equal draws.
    """
    n, (last, lo, hi) = cell.num_rows, (cell.column(c)[0].as_py() for c in ("last", "lo", "hi"))
    part = cell.column("part").to_numpy()
    bands = np.array(cell.column("earlier").to_pylist(), np.int64).reshape(n, last)
    drawn = np.frombuffer(b"".join(cell.column("drawn").to_pylist()), np.uint8).reshape(n, -1)
    for i in range(n):
        mine = np.arange(i + 1, n) if lo == hi else np.flatnonzero(part == hi) if part[i] == lo else np.empty(0, np.int64)
        mine = mine[label[mine] != label[i]]
        mine = mine[(drawn[mine] == drawn[i]).mean(axis=1) >= HOPEFUL]
        yield i, mine[~(bands[mine] == bands[i]).any(axis=1)]


def shared_weights(mine: slice, others: np.ndarray, starts: np.ndarray, shingle: np.ndarray, weight: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The shared weight of one member of a cell with each of ``others``; ``dense`` is all zero before and after."""
    dense[shingle[mine]] = weight[mine]
    counts = starts[others + 1] - starts[others]
    edges = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(starts[others] - edges, counts)
    found = np.add.reduceat(np.minimum(dense[shingle[at]], weight[at]), edges)
    dense[shingle[mine]] = 0
    return found


CELL = ["bucket", "lo", "hi"]


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def unmet(members: DataFrame) -> DataFrame:
    """(bucket, node): members (bucket, last, node, label, earlier, drawn) with a partner to be compared with in that bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cell_tables(batches):
            wanted = np.zeros(cell.num_rows, bool)
            for i, mine in partners(cell, labels_in(cell)):
                if len(mine):
                    wanted[i] = wanted[mine] = True
            if wanted.any():
                yield from cell.select(["bucket", "node"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    size = F.lit(128) + 8 * F.col("last") + F.length("drawn")
    rows = in_cells(members, size).select(*CELL, "part", "last", "node", "label", "earlier", "drawn")
    return in_order(rows).mapInArrow(work, "bucket long, node binary").distinct()


def met(members: DataFrame, similar: float) -> DataFrame:
    """Pairs at or above the threshold among members (as for ``unmet``, and their shingles and weights) of one bucket.

    They join all components that any such pair joins; a cell gives no second
    pair for two components it has joined.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cell_tables(batches):
            cell = cell.combine_chunks()
            lists = [cell.column(c).combine_chunks() for c in ("shingles", "weights")]
            starts = np.append(0, np.cumsum(pc.list_value_length(lists[0]).to_numpy(False))).astype(np.int64)
            names, shingle = np.unique(lists[0].flatten().to_numpy(), return_inverse=True)
            weight = lists[1].flatten().to_numpy()
            total, dense = np.add.reduceat(weight, starts[:-1]), np.zeros(len(names))
            node, label = cell.column("node").to_pylist(), labels_in(cell)
            for i, mine in partners(cell, label):
                # bounded by bytes: the shingles of some partners at a time
                groups = np.cumsum(starts[mine + 1] - starts[mine]) // (BLOCK_BYTES // 16)
                for some in np.split(mine, np.flatnonzero(np.diff(groups)) + 1) if len(mine) else []:
                    shared = shared_weights(slice(starts[i], starts[i + 1]), some, starts, shingle, weight, dense)
                    alike = shared / (total[i] + total[some] - shared)
                    near = np.flatnonzero((alike >= similar - 1e-12) & (label[some] != label[i]))
                    if len(near):
                        near = near[np.unique(label[some[near]], return_index=True)[1]]
                        label[np.isin(label, label[some[near]])] = label[i]
                        columns = [pa.array([node[i]] * len(near), pa.binary()), pa.array([node[k] for k in some[near]], pa.binary())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(alike[near])], ["a", "b", "similarity"])

    rows = in_cells(members, F.lit(256) + 16 * F.size("shingles"))
    rows = rows.select(*CELL, "part", "last", "node", "label", "earlier", "drawn", "shingles", "weights")
    return in_order(rows).mapInArrow(work, "a binary, b binary, similarity double")


def judged_rows(docs: DataFrame, key: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """``classes``, with the ``digest`` of each row's text."""
    python_workers(docs.sparkSession)
    sketch, documents = frequency_sketch(docs, text)
    rows = written_once(signatures(docs, key, text, sketch, documents).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first_id = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "row"))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("drawn").alias("drawn"), first_id.alias("first"), F.count(F.lit(1)).alias("n")
    )
    nodes = written_once(nodes, "nodes")
    drawn = nodes.select("node", "drawn")

    def edges(pairs: DataFrame) -> DataFrame:
        likely = written_once(hopeful(pairs, drawn), "pairs")
        ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("first.id").alias("id"))
        return written_once(verified(likely, vectors(docs, key, text, wanted, sketch, documents), similar), "edges")

    members = written_once(bucket_members(nodes), "members")
    found = edges(star_pairs(members.withColumn("label", F.col("node")), F.col("score")))
    rest = divided(undecided(members, sized_components(found)), nodes)
    lot = F.struct("alike", F.xxhash64("bucket", "node"))
    found = found.unionByName(edges(star_pairs(rest, lot)))
    labels = sized_components(found)
    apart = undecided(members, labels).join(nodes.select("node", "bands", "drawn"), "node")
    apart = written_once(apart.select("bucket", "last", "node", "label", F.slice("bands", 1, F.col("last")).alias("earlier"), "drawn"), "apart")
    wanted = written_once(unmet(apart), "unmet")
    if not wanted.isEmpty():
        firsts = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", F.col("first.id").alias("id"))
        texts = written_once(vectors(docs, key, text, firsts, sketch, documents), "vectors")
        apart = apart.join(wanted, ["bucket", "node"], "left_semi").join(texts, "node")
        labels = connected_components(found.unionByName(written_once(met(apart, similar), "met")))
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first", "n")
    least = named.groupBy("label").agg(F.min("first").alias("_best"), F.sum("n").alias("class_rows"))
    named = named.join(least, "label").select("node", "_best", "class_rows")
    out = rows.join(named, "node", "left")
    alone = F.col("_best").isNull()
    return out.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("_best.id")).alias("class_id"),
        F.when(alone, 1).otherwise(F.col("class_rows")).alias("class_rows"),
        (alone | (F.col("row") == F.col("_best.row"))).alias("kept"),
        "digest",
    )


def classes(docs: DataFrame, key: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the least id of its class), class_rows and kept.

    In each class one row is kept: one with the least id, null ids last.  A
    null text or one without words is like no other; it is a class of its own
    and kept.  Texts of the same words are always together.  Of repeated rows
    (equal id and words) all but one are not kept.  Other columns are ignored.
    """
    return judged_rows(docs, key, text, similar).drop("digest")


def deduplicate(docs: DataFrame, key: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """Rows of ``docs`` without near duplicates, all columns: one document of each class stays.

    Each row stays or goes by its own text, also where rows share a key or have
    none.  Of rows that are equal in key and text one stays.
    """
    judged = written_once(judged_rows(docs, key, text, similar), "classes")
    same = judged.groupBy("id", "digest").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    name = free_name(docs.columns, "_digest")
    marked = docs.withColumn(name, digest_of(F.col(f"`{text}`")))
    gone = broadcast_if_small(same.where("not _kept").select("id", "digest"), ID_LIMIT)
    stay = join_rows(marked, [key, name], gone, "left_anti")
    repeated = same.where("_kept and _n > 1").select("id", "digest")
    if repeated.isEmpty():
        return stay.drop(name)
    once = join_rows(stay, [key, name], repeated, "left_semi").dropDuplicates([key, text])
    return join_rows(stay, [key, name], repeated, "left_anti").unionByName(once).drop(name)
