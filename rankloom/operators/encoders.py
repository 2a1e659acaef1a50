"""Categorical dictionaries: fit, encode, extend.

A dictionary is one DataFrame (column string, value string, idx bigint) for all
encoded columns.  Values are trimmed before counting and before lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.operators.chunks import number_rows, written_once
from rankloom.operators.samples import dedup
from rankloom.operators.sizing import BROADCAST_LIMIT, ROW_OVERHEAD, measured_bytes
from rankloom.session import scratch_path, shuffle_width

UNKNOWN = -1


def trimmed(name: str) -> F.Column:
    return F.trim(F.col(name).cast("string"))


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): every encoded column counted in one pass over the data."""
    require_columns(df, columns)
    texts = df.select(*[trimmed(c).alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value").where(F.length("value") > 0)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def dense_index(df: DataFrame, key: str, start: int = 0) -> DataFrame:
    """(key, idx): values numbered from ``start`` by count descending, then value ascending."""
    counts = df.select(trimmed(key).alias(key)).where(F.length(key) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    numbered = number_rows(counts, [F.col("n").desc(), F.col(key).asc()])
    return numbered.select(key, (F.col("idx") + F.lit(start)).alias("idx"))


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column gets 0; ties go by value."""
    numbered = number_rows(
        column_values(df, columns), [F.col("n").desc(), F.col("value").asc()], within=["column"]
    )
    return numbered.select("column", "value", "idx")


def max_index(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("column").agg(F.max("idx").alias("max_idx"))


def unseen_values(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    return column_values(df, columns).join(dictionary, ["column", "value"], "left_anti")


def new_entries(df: DataFrame, dictionary: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Entries for the values of ``df`` that the dictionary does not have yet.

    They follow the old maximum of their column in frequency order of ``df``.
    """
    if dictionary is None:
        return fit_dictionary(df, columns)
    fresh = number_rows(
        unseen_values(df, dictionary, columns),
        [F.col("n").desc(), F.col("value").asc()],
        within=["column"],
        out="_rank",
    )
    # one row per encoded column
    start = max_index(dictionary)
    return fresh.join(F.broadcast(start), "column", "left").select(
        "column", "value", (F.coalesce(F.col("max_idx") + 1, F.lit(0)) + F.col("_rank")).alias("idx")
    )


def extend_dictionary(df: DataFrame, dictionary: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Keep every old number and add the new entries."""
    added = new_entries(df, dictionary, columns)
    if dictionary is None:
        return added
    return dictionary.select("column", "value", "idx").unionByName(added)


#: rows that one task counts by their value
COUNTED_ROWS = 1 << 20


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n): rows of each value, NULL included.

    Rows are dealt by value first, to as many tasks as their number asks for: a
    table of nearly all values in every reading task would not combine anything.
    The counts are stored: joins with them would be pushed down to the rows.
    """
    parts = max(shuffle_width(df.sparkSession), -(-df.count() // COUNTED_ROWS))
    counts = df.select(column).repartition(parts, column).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return written_once(counts, "value-counts")


def split_seen_unseen(df: DataFrame, dictionary: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is known, and the rest (NULL counts as unseen).

    Where rows only matter by their value, count them first (``value_counts``).
    """
    known = dictionary.where(F.col("column") == column).select(F.col("value").alias("_value"))
    # Spark's own choice would broadcast values whose compressed file is small
    known = known.hint("broadcast" if measured_bytes(known) <= BROADCAST_LIMIT else "merge")
    condition = trimmed(column) == F.col("_value")
    return df.join(known, condition, "left_semi"), df.join(known, condition, "left_anti")


def dictionary_bytes(dictionary: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Measured size of every column's entries, in one aggregation (one row per column)."""
    size = F.sum(F.length("value") * 4 + F.lit(8 + ROW_OVERHEAD))
    rows = dictionary.where(F.col("column").isin(list(columns))).groupBy("column").agg(size.alias("n")).collect()
    return {r["column"]: int(r["n"]) for r in rows}


def within_budget(sizes: dict[str, int], columns: Sequence[str], budget: int) -> list[str]:
    """The columns whose dictionaries are broadcast: the smallest first, while all together stay within the budget."""
    chosen, used = [], 0
    for c in sorted(columns, key=lambda c: (sizes.get(c, 0), c)):
        used += sizes.get(c, 0)
        if used > budget:
            break
        chosen.append(c)
    return chosen


def encode_columns(
    df: DataFrame, dictionary: DataFrame, columns: Sequence[str], broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Replace each value by its number; unseen and NULL become -1.

    Columns whose dictionaries together measure at most ``broadcast_limit``
    bytes are looked up in place, without moving the data.  A single column
    beyond that is looked up by one move of the data; several are looked up at
    once, see ``encode_long``: two moves of the data however many columns there
    are.
    """
    require_columns(df, columns)
    sizes = dictionary_bytes(dictionary, columns)
    small = within_budget(sizes, columns, broadcast_limit)
    order, large = df.columns, [c for c in columns if c not in small]
    if len(large) == 1:
        df = looked_up(df, dictionary, large[0], "merge")
    elif large:
        df = encode_long(df, dictionary, large)
    for c in small:
        df = looked_up(df, dictionary, c, "broadcast")
    return df.select(*order)


def looked_up(df: DataFrame, dictionary: DataFrame, column: str, join: str) -> DataFrame:
    """``column`` replaced by its numbers; ``join`` is the hint for the entries.

    Spark's own choice would broadcast entries whose compressed file is small.
    The text leaves the rows before they move.  Very frequent values, and the
    rows without one, are split by adaptive execution.
    """
    entries = dictionary.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
    rows = df.withColumn(column, trimmed(column))
    found = rows.join(entries.hint(join), F.col(column) == F.col("_value"), "left")
    return found.withColumn(column, F.coalesce("_idx", F.lit(UNKNOWN).cast("bigint"))).drop("_value", "_idx")


def encode_long(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``encode_columns`` by one join: a row for each (row, column, value), and one regrouping by row.

    The rest of a row travels with its first value only.  Rows are numbered
    and stored first, so that a repeated task gives them the same numbers.
    A dictionary that is bucketed by column and value (``save_bucketed``) does
    not move.  Very frequent values are split by adaptive execution.
    """
    rest = [c for c in df.columns if c not in columns]
    rows = written_once(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    payload = F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), trimmed(c).alias("value"), F.lit(i).alias("at")) for i, c in enumerate(columns)])
    long = rows.select("_row", payload.alias("_rest"), F.inline(cells))
    long = long.withColumn("_rest", F.when(F.col("at") == 0, F.col("_rest")))
    # the entries are few columns of text and number; the rows keep their side of the join
    entries = dictionary.select(F.col("column").alias("_c"), F.col("value").alias("_v"), F.col("idx").alias("_idx"))
    found = long.join(entries, (F.col("column") == F.col("_c")) & (F.col("value") == F.col("_v")), "left")
    codes = [F.max(F.when(F.col("at") == i, F.col("_idx"))).alias(c) for i, c in enumerate(columns)]
    packed = found.groupBy("_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), *codes)
    unknown = [F.coalesce(c, F.lit(UNKNOWN).cast("bigint")).alias(c) for c in columns]
    return packed.select(*[F.col("_rest").getField(c).alias(c) for c in rest], *unknown).select(*df.columns)


def save_bucketed(dictionary: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Store a dictionary as a table bucketed and sorted by column and value, ready for joins in which it does not move.

    Its files lie in a fresh scratch folder.
    """
    spark = dictionary.sparkSession
    writer = dictionary.select("column", "value", "idx").write.bucketBy(buckets or shuffle_width(spark), "column", "value")
    writer.sortBy("column", "value").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


class FrequencyEncoder:
    """fit / transform / extend over a chosen set of columns."""

    def __init__(self, columns: Sequence[str], dictionary: DataFrame | None = None):
        self.columns = list(columns)
        self.dictionary = dictionary

    def fit(self, df: DataFrame) -> FrequencyEncoder:
        return FrequencyEncoder(self.columns, fit_dictionary(df, self.columns))

    def extend(self, df: DataFrame) -> FrequencyEncoder:
        return FrequencyEncoder(self.columns, extend_dictionary(df, self.dictionary, self.columns))

    def transform(
        self, df: DataFrame, unique_key: str | None = None, order: Sequence[str] = ()
    ) -> DataFrame:
        """Encode; with ``unique_key`` also keep one row per key, the first under ``order``."""
        encoded = encode_columns(df, self.dictionary, self.columns)
        if unique_key is None:
            return encoded
        return dedup(encoded, [unique_key], list(order) or [c for c in encoded.columns if c != unique_key])

    def save(self, path: str) -> None:
        """One folder per column, so later reads prune to the columns they need."""
        self.dictionary.write.mode("overwrite").partitionBy("column").parquet(path)

    @staticmethod
    def load(spark, path: str, columns: Sequence[str]) -> FrequencyEncoder:
        schema = "value string, idx bigint, column string"
        table = spark.read.schema(schema).parquet(path).select("column", "value", "idx")
        return FrequencyEncoder(columns, table.where(F.col("column").isin(list(columns))))
