"""Embedding lookups, pooling, interactions, pair scores and retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.functions import arrays
from rankloom.functions.scalars import sigmoid
from rankloom.operators.sizing import broadcast_if_small, measured_bytes
from rankloom.session import shuffle_width


def lookup_embeddings(
    df: DataFrame, keys: Sequence[str], ids: str, table: DataFrame, id_col: str, vec_col: str, out: str = "vectors"
) -> DataFrame:
    """Id list -> list of vectors in list order; an id missing from the table gives NULL there.

    An empty list stays empty and a NULL list NULL.  The re-collected list is as
    long as the id list, a contract constant.  ``keys`` name each row and table
    ids are unique, see ``dedup``.
    """
    flat = df.select(*keys, F.col(ids).isNull().alias("_none"), F.posexplode_outer(ids).alias("_pos", "_id"))
    vectors = broadcast_if_small(table.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")))
    found = flat.join(vectors, "_id", "left")
    place = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_vec"))
    packed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(place)).alias("_v"), F.max("_none").alias("_none"))
    return packed.select(*keys, F.when(~F.col("_none"), F.transform("_v", lambda s: s["_vec"])).alias(out))


def sum_pool_sequence(
    df: DataFrame, keys: Sequence[str], ids: str, table: DataFrame, id_col: str, vec_col: str, out: str = "pooled"
) -> DataFrame:
    """Sum of the vectors of all real ids (id > 0); padding and unknown ids add nothing.

    Every row stays: one whose list is NULL, empty, all padding or unknown has
    a vector of zeros.  Vectors are summed as vectors with partial aggregation:
    no per-dimension rows and no re-collected lists.
    """
    flat = df.select(*keys, F.explode_outer(ids).alias("_id")).withColumn("_id", F.when(F.col("_id") > 0, F.col("_id")))
    vectors = table.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    width = vectors.agg(F.coalesce(F.max(F.size("_vec")), F.lit(0)).alias("n")).scalar()
    found = flat.join(broadcast_if_small(vectors), "_id", "left")
    found = found.withColumn("_vec", F.coalesce("_vec", F.array_repeat(F.lit(0.0), width)))
    summed = found.groupBy(*keys).agg(Summarizer.sum(array_to_vector(F.col("_vec"))).alias("_sum"))
    return summed.select(*keys, vector_to_array("_sum").alias(out))


def score_pairs(
    pairs: DataFrame, users: DataFrame, items: DataFrame, user_id: str, item_id: str, vec: str = "vec"
) -> DataFrame:
    """Sigmoid of the dot product of the two towers' vectors, for the given pairs only; NULL where a vector is missing."""
    u = users.select(user_id, F.col(vec).cast("array<double>").alias("_u"))
    i = items.select(item_id, F.col(vec).cast("array<double>").alias("_i"))
    joined = pairs.join(broadcast_if_small(u), user_id, "left").join(broadcast_if_small(i), item_id, "left")
    return joined.withColumn("score", sigmoid(arrays.dot(F.col("_u"), F.col("_i")))).drop("_u", "_i")


#: scores held at a time while blocks are multiplied out
CELL_SCORES = 1_000_000
#: items in a block that is skipped as a whole, and bytes of items that are shipped to every task
ITEM_BLOCK, ITEM_BYTES = 4_096, 128 << 20
#: room for rounding in the comparison of a bound with a score
SLACK = 1e-9


@dataclass(frozen=True)
class ItemBlocks:
    """Items by falling length of their vectors, in blocks; ``bounds`` are the greatest lengths in each."""

    ids: np.ndarray
    matrix: np.ndarray
    bounds: np.ndarray
    size: int

    @classmethod
    def of(cls, ids: np.ndarray, matrix: np.ndarray, size: int = ITEM_BLOCK) -> ItemBlocks:
        length = np.linalg.norm(matrix, axis=1)
        order = np.lexsort((ids, -length))
        return cls(ids[order], matrix[order], length[order][::size], size)


def best_of(vectors: np.ndarray, items: ItemBlocks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vector, item, score) of the ``k`` best items of each vector, best first (ties: smaller id), and how many
    (vector, block) pairs were skipped.

    By the inequality of Cauchy and Schwarz no score in a block exceeds the
    vector's length times the block's bound; once that is below a vector's k-th
    score, this and all later blocks are skipped for it.
    """
    n, skipped = len(vectors), 0
    length = np.linalg.norm(vectors, axis=1)
    row, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    floor = np.full(n, -np.inf)
    for b, bound in enumerate(items.bounds):
        open_ = np.flatnonzero(length * bound * (1 + SLACK) + SLACK >= floor)
        skipped += n - len(open_)
        if not len(open_):
            skipped += n * (len(items.bounds) - b - 1)
            break
        part = slice(b * items.size, (b + 1) * items.size)
        found = vectors[open_] @ items.matrix[part].T
        least = floor[open_]
        if found.shape[1] > k and np.isneginf(least).any():
            # nothing to beat yet: only the block's own k best are kept and put in order, not all of its scores
            least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
        at, col = np.nonzero(found >= least[:, None])
        row, ids = np.concatenate([row, open_[at]]), np.concatenate([ids, items.ids[part][col]])
        score = np.concatenate([score, found[at, col]])
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        row, ids, score, place = row[kept], ids[kept], score[kept], place[kept]
        floor[row[place == k - 1]] = score[place == k - 1]
    return row, ids, score, skipped


def top_items(
    users: DataFrame,
    items: DataFrame,
    k: int,
    user_id: str = "user_id",
    item_id: str = "item_id",
    vec: str = "vec",
    users_per_cell: int = 20_000,
    items_per_cell: int = 50_000,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Exact k best items per user by dot product (ties: smaller item id).

    While the item vectors measure at most ``item_bytes``, they are shipped to
    every task once and users pass by where they lie: no shuffle, and most
    blocks of items are skipped by their bound.  More items than that are dealt
    into cells, see ``top_items_by_cell``.  A user or item without a vector has
    no rows.
    """
    users, items = users.where(F.col(vec).isNotNull()), items.where(F.col(vec).isNotNull())
    held = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(vec).cast("array<double>").alias("iv"))
    if measured_bytes(held) > item_bytes:
        return top_items_by_cell(users, items, k, user_id, item_id, vec, users_per_cell, items_per_cell)
    table = held.toArrow()
    ids = table.column("i").to_numpy()
    matrix = table.column("iv").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
    sent = users.sparkSession.sparkContext.broadcast(ItemBlocks.of(ids, matrix))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        step = max(1, CELL_SCORES // blocks.size)
        for batch in batches:
            for start in range(0, batch.num_rows if len(blocks.ids) else 0, step):
                part = batch.slice(start, step)
                vectors = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                row, found, score, _ = best_of(vectors, blocks, k)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                columns = [part.column(0).take(pa.array(row)), pa.array(found), pa.array(score), pa.array(rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["u", "i", "s", "rank"])

    rows = users.select(F.col(user_id).cast("bigint").alias("u"), F.col(vec).cast("array<double>").alias("uv"))
    found = rows.mapInArrow(best, "u bigint, i bigint, s double, rank int")
    return found.select(F.col("u").alias(user_id), F.col("i").alias(item_id), F.col("s").alias("score"), "rank")


def top_items_by_cell(
    users: DataFrame, items: DataFrame, k: int, user_id: str, item_id: str, vec: str, users_per_cell: int, items_per_cell: int
) -> DataFrame:
    """``top_items`` for items too many for one task.

    Users and items are hashed into blocks; every (user block, item block) cell
    is one bounded task that multiplies two matrices and keeps k rows per
    user, so no user-item pair table ever exists.  A final per-user cut merges
    the item blocks.
    """
    n_users, n_items = users.count(), items.count()
    user_blocks = max(1, -(-n_users // users_per_cell))
    item_blocks = max(1, -(-n_items // items_per_cell))

    def block(key: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def replicate(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    u = users.select(
        F.col(user_id).cast("bigint").alias("u"),
        F.col(vec).cast("array<double>").alias("uv"),
        block(user_id, user_blocks).alias("ub"),
        replicate(item_blocks).alias("ib"),
    )
    i = items.select(
        F.col(item_id).cast("bigint").alias("i"),
        F.col(vec).cast("array<double>").alias("iv"),
        block(item_id, item_blocks).alias("ib"),
        replicate(user_blocks).alias("ub"),
    )

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"u": [], "i": [], "s": []}).astype({"u": "int64", "i": "int64", "s": "float64"})
        order = np.argsort(right["i"].to_numpy(), kind="stable")
        ids = right["i"].to_numpy()[order]
        matrix = np.stack(right["iv"].to_numpy())[order].T
        vectors, owners = np.stack(left["uv"].to_numpy()), left["u"].to_numpy()
        keep = min(k, len(ids))
        rows_at_once = max(1, CELL_SCORES // len(ids))
        found = []
        for start in range(0, len(owners), rows_at_once):
            scores = vectors[start : start + rows_at_once] @ matrix
            floor = np.partition(scores, -keep, axis=1)[:, -keep]
            row, col = np.nonzero(scores >= floor[:, None])
            value = scores[row, col]
            by = np.lexsort((col, -value, row))
            row, col, value = row[by], col[by], value[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            chosen = place < keep
            found.append(pd.DataFrame({"u": owners[start + row[chosen]], "i": ids[col[chosen]], "s": value[chosen]}))
        return pd.concat(found)

    cells = (
        u.groupBy("ub", "ib").cogroup(i.groupBy("ub", "ib")).applyInPandas(best, "u bigint, i bigint, s double")
    )
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("s").desc(), "i"))
    return (
        cells.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select(F.col("u").alias(user_id), F.col("i").alias(item_id), F.col("s").alias("score"), "rank")
    )


def split_fields(vector: Column, fields: int, dim: int) -> Column:
    """Concatenated vector -> array of ``fields`` embeddings of ``dim`` values."""
    return F.array(*[F.slice(vector, f * dim + 1, dim).cast("array<double>") for f in range(fields)])


def fm_second_order(embeddings: Column, dim: int) -> Column:
    """0.5 * ((sum v)^2 - sum v^2) per dimension over a row's field embeddings."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    sums = F.aggregate(embeddings, zeros, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    squares = F.aggregate(embeddings, zeros, lambda s, v: F.zip_with(s, v, lambda a, b: a + b * b))
    return F.zip_with(sums, squares, lambda a, b: (a * a - b) * 0.5)


def pairwise_interaction(embeddings: Column, dim: int) -> Column:
    """Mean product of all ordered pairs of different fields, halved: fm / number of fields."""
    n = F.size(embeddings).cast("double")
    return F.transform(fm_second_order(embeddings, dim), lambda v: v / n)


MOMENTS = "grp int, n bigint, mean array<double>, spread array<double>"


def merged_moments(parts: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, means and centred products of each group from those of its parts, which may come in any order."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for grp, n, mean, spread in parts:
        if grp in held:
            m, old, products = held[grp]
            gap = mean - old
            products = products + spread + np.outer(gap, gap) * (m * n / (m + n))
            held[grp] = (m + n, old + gap * (n / (m + n)), products)
        elif n:
            held[grp] = (n, mean, spread)
    return held


def group_moments(df: DataFrame, column: str, m: int) -> DataFrame:
    """(grp, n, mean, spread) of each group of ``m`` neighbouring slots; ``spread`` is the m x m matrix of centred products.

    One pass: every task centres its rows on its own means, and the parts are
    merged in two levels, first by about the square root of the tasks, so that
    no task takes a part from every other.  Rows without a vector are left out.
    """
    require_columns(df, [column])
    spark = df.sparkSession
    rows = df.select(F.col(column).cast("array<double>").alias("x")).where(F.col("x").isNotNull())

    def out(held: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        if held:
            yield pd.DataFrame([(g, n, mean, spread.ravel()) for g, (n, mean, spread) in held.items()], columns=["grp", "n", "mean", "spread"])

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_numpy())
                    if x.shape[1] % m:
                        raise ValueError(f"{x.shape[1]} slots do not split into groups of {m}")
                    x = x.reshape(len(x), -1, m)
                    means = x.mean(axis=0)
                    x = x - means
                    spread = np.einsum("ngi,ngj->gij", x, x)
                    yield from ((g, len(x), means[g], spread[g]) for g in range(len(means)))

        yield from out(merged_moments(parts()))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (
            (int(g), int(n), np.asarray(mean), np.asarray(spread).reshape(m, m))
            for batch in batches
            for g, n, mean, spread in zip(batch["grp"], batch["n"], batch["mean"], batch["spread"])
        )
        yield from out(merged_moments(parts))

    width = shuffle_width(spark)
    partial = rows.mapInPandas(centred, MOMENTS)
    middle = partial.withColumn("_salt", F.spark_partition_id() % max(2, round(width**0.5))).repartition(width, "grp", "_salt")
    return middle.drop("_salt").mapInPandas(merged, MOMENTS).repartition("grp").mapInPandas(merged, MOMENTS)


def covariance_of(moments: DataFrame, m: int, epsilon: float = 1e-3, means: Sequence[float] | None = None) -> DataFrame:
    """(grp, i, j, cov) of stored or computed moments, about their means or the given ones."""
    cell = moments.select("grp", "n", "mean", F.posexplode("spread").alias("at", "g"))
    i, j = F.floor(F.col("at") / m).cast("int"), (F.col("at") % m).cast("int")
    products = F.col("g")
    if means is not None:
        given = F.array(*[F.lit(float(v)) for v in means])
        off = lambda k: F.get("mean", k) - F.get(given, F.col("grp") * m + k)
        products = products + F.col("n") * off(i) * off(j)
    shrunk = products / (F.col("n") - 1) * (1.0 - epsilon) + F.when(i == j, F.lit(epsilon)).otherwise(0.0)
    return cell.select("grp", i.alias("i"), j.alias("j"), shrunk.alias("cov"))


def group_covariance(
    df: DataFrame, column: str, m: int, epsilon: float = 1e-3, means: Sequence[float] | None = None
) -> DataFrame:
    """(grp, i, j, cov): covariance inside each group of ``m`` neighbouring slots,
    shrunk to (1 - eps) C + eps I.  See ``group_moments``."""
    return covariance_of(group_moments(df, column, m), m, epsilon, means)


class Whitening:
    """Per-group whitening: subtract the mean, multiply by the inverse square root of the covariance.

    The covariance is computed on the cluster; only the m x m matrices (m is a
    few hundred at most) are factorised on the driver.
    """

    KINDS = ("cholesky", "zca", "pca", "iter_norm")

    def __init__(self, means: np.ndarray, matrices: np.ndarray):
        self.means, self.matrices = means, matrices

    @staticmethod
    def parse(text: str) -> dict:
        """``center-group-m-kind-iterations-affine``, e.g. ``0-1-16-zca-5-0``."""
        center, group, m, kind, iterations, affine = text.split("-")
        return {
            "center": int(center), "group": int(group), "m": int(m), "kind": kind,
            "iterations": int(iterations), "affine": bool(int(affine)),
        }

    @staticmethod
    def inverse_root(cov: np.ndarray, kind: str, epsilon: float = 1e-3, iterations: int = 5) -> np.ndarray:
        eye = np.eye(len(cov))
        if kind == "cholesky":
            return np.linalg.solve(np.linalg.cholesky(cov), eye)
        if kind in ("zca", "pca"):
            values, vectors = np.linalg.eigh(cov + eye * epsilon)
            values, vectors = values[::-1], vectors[:, ::-1]
            scaled = vectors.T / np.sqrt(values)[:, None]
            return vectors @ scaled if kind == "zca" else scaled
        if kind == "iter_norm":
            # coupled Newton-Schulz steps: the same limit as the plain iteration, without its round-off growth
            trace = np.trace(cov)
            product, root = cov / trace, eye
            for _ in range(iterations):
                factor = 1.5 * eye - 0.5 * root @ product
                product, root = product @ factor, factor @ root
            return root / np.sqrt(trace)
        raise ValueError(f"unknown whitening {kind!r}; one of {Whitening.KINDS}")

    @staticmethod
    def fit(
        df: DataFrame, column: str, m: int, kind: str = "zca", epsilon: float = 1e-3, iterations: int = 5
    ) -> Whitening:
        rows = sorted(group_moments(df, column, m).collect())  # m * (m + 1) numbers for each group
        covariance = [np.array(r["spread"]).reshape(m, m) / (r["n"] - 1) * (1 - epsilon) + epsilon * np.eye(m) for r in rows]
        roots = np.stack([Whitening.inverse_root(c, kind, epsilon, iterations) for c in covariance])
        return Whitening(np.concatenate([np.array(r["mean"]) for r in rows]), roots)

    def transform(self, df: DataFrame, column: str, out: str = "whitened") -> DataFrame:
        means, matrices = self.means, self.matrices
        groups, m = matrices.shape[0], matrices.shape[1]

        @F.pandas_udf("array<double>")
        def whiten(x: pd.Series) -> pd.Series:
            flat = (np.stack(x.to_numpy()) - means).reshape(-1, groups, m)
            return pd.Series(list(np.einsum("gij,ngj->ngi", matrices, flat).reshape(len(flat), -1)))

        return df.withColumn(out, whiten(F.col(column).cast("array<double>")))


def moving_average(previous: Column, current: Column, momentum: float = 0.99) -> Column:
    return previous * F.lit(momentum) + current * F.lit(1.0 - momentum)


def moving_stats(previous: DataFrame | None, current: DataFrame, keys: Sequence[str], momentum: float = 0.99) -> DataFrame:
    """Exponential moving statistics: ``previous`` and ``current`` hold (keys, value).

    The first batch is taken as it is; keys missing on one side keep the other value.
    """
    if previous is None:
        return current
    old = previous.select(*keys, F.col("value").alias("_old"))
    joined = current.join(old, list(keys), "full_outer")
    mixed = moving_average(F.col("_old"), F.col("value"), momentum)
    return joined.select(*keys, F.coalesce(mixed, F.col("_old"), F.col("value")).alias("value"))
