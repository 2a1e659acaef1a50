"""Order-dependent work split into value ranges.

Ranks, running totals and exact percentiles need an order, but one window over
all rows (or over one huge group) is a single task.  Here the value axis is cut
into ranges holding about the same number of rows; work happens per
(group, range) and only the per-range totals (at most ``shuffle partitions``
rows per group) are ordered as a whole.  The cut points only balance the work:
any cut points give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.session import scratch_path, shuffle_width

CHUNK = "_chunk"


PROBES = [i / 256 for i in range(257)]


#: groups of input tasks that are sketched by themselves; their probes meet on the driver
SKETCHES = 256


def quantile_cuts(df: DataFrame, value: str, parts: int) -> list[float]:
    """Approximate cut points for ``parts`` ranges of about equally many rows.

    Each group of input tasks gives 257 probe points of its own sketch and its
    number of rows; the cuts are quantiles of all probes, each weighing its
    share of those rows, so a few large input tasks and many small ones make no
    difference.  At most 256 groups, hence 65,792 numbers, reach the driver.  A
    value found at several cut points stays repeated (see ``has_heavy_values``).
    """
    groups = min(SKETCHES, shuffle_width(df.sparkSession))
    local = df.select(F.col(value).cast("double").alias("_v"), (F.spark_partition_id() % groups).alias("_g"))
    rows = local.groupBy("_g").agg(F.percentile_approx("_v", PROBES, 1_000).alias("probes"), F.count("_v").alias("n")).collect()
    # NaN sorts above every number, like infinity
    probes = sorted((float("inf") if v != v else float(v), r["n"]) for r in rows for v in r["probes"] or [])
    total, seen, cuts = sum(n for _, n in probes), 0, []
    for v, n in probes:
        seen += n
        while len(cuts) < parts - 1 and seen * parts >= (len(cuts) + 1) * total:
            cuts.append(v)
    return cuts


def hot_groups(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple]:
    """Keys of the groups with more than one ``parts``-th of all rows: fewer than ``parts``.

    One scan of ``df``; the counts of the groups are stored and read twice.
    """
    counts = written_once(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return [tuple(r[:-1]) for r in counts.where(F.col("_n") * parts > total).collect()]


def flag_groups(df: DataFrame, keys: Sequence[str], groups: Sequence[tuple], out: str = "_hot") -> DataFrame:
    """``df`` with a flag for the rows of ``groups``; null is a key like any other.

    The groups (fewer than there are shuffle partitions) are joined as a
    broadcast table, so a row costs one lookup however many they are.
    """
    if not keys or not groups:
        return df.withColumn(out, F.lit(bool(groups)))
    names = [f"_hot{i}" for i in range(len(keys))]
    schema = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)])
    wanted = df.sparkSession.createDataFrame([tuple(g) for g in groups], schema).withColumn(out, F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(F.broadcast(wanted), same, "left").withColumn(out, F.coalesce(out, F.lit(False))).drop(*names)


def has_heavy_values(cuts: Sequence[float]) -> bool:
    """True when one value may fill a whole range, or when nothing is known.

    Then rows are combined per value before they are ordered; otherwise no
    range can hold much more than its share and ordering the rows directly
    saves a shuffle.
    """
    return len(cuts) < 2 or len(set(cuts)) < len(cuts)


def with_chunk(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Add the number of the range each value falls in (an integer: it is a shuffle key)."""
    inner = sorted({c for c in cuts if abs(c) != float("inf")})
    if not inner:
        return df.withColumn(CHUNK, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=value, outputCol=CHUNK, handleInvalid="keep")
    return bucketizer.transform(df).withColumn(CHUNK, F.col(CHUNK).cast("int"))


def value_histogram(
    df: DataFrame, keys: Sequence[str], value: str, aggregates: Sequence[Column], cuts: Sequence[float] | None = None
) -> DataFrame:
    """One row per (keys, value) with its range number; repeated values combine before the shuffle."""
    if cuts is None:
        cuts = quantile_cuts(df, value, shuffle_width(df.sparkSession))
    hist = df.groupBy(*keys, value).agg(*aggregates)
    return with_chunk(hist, value, cuts)


def before_in_chunk(keys: Sequence[str], value: str):
    return (
        Window.partitionBy(*keys, CHUNK).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )


def before_chunk(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated percentiles, one row per (keys, p), without gathering a group.

    The wanted positions are looked up from per-range counts; every range is
    ordered on its own.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    cuts = quantile_cuts(base, "_v", shuffle_width(df.sparkSession))
    if has_heavy_values(cuts):
        hist = value_histogram(base, keys, "_v", [F.count(F.lit(1)).alias("_c")], cuts)
    else:
        hist = with_chunk(base.withColumn("_c", F.lit(1).cast("bigint")), "_v", cuts)
    totals = hist.groupBy(*keys, CHUNK).agg(F.sum("_c").alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    totals = totals.select(
        *keys,
        CHUNK,
        "_n",
        F.coalesce(F.sum("_n").over(before_chunk(keys)), F.lit(0)).alias("_start"),
        F.sum("_n").over(group).alias("_total"),
    )
    # only the ranges that hold a wanted position are ordered: at most two for each percentile and group
    spot = lambda p: p * (F.col("_total") - 1)
    inside = lambda at: (at >= F.col("_start")) & (at < F.col("_start") + F.col("_n"))
    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probabilities]), lambda p: inside(F.floor(spot(p))) | inside(F.ceil(spot(p)))
    )
    spots = totals.withColumn("_wanted", wanted).where(F.size("_wanted") > 0)
    names = [f"_k{i}" for i in range(len(keys))]
    spots = spots.toDF(*names, "_range", "_size", "_start", "_total", "_wanted").drop("_size")
    same = F.col(CHUNK) == F.col("_range")
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    held = hist.join(spots, same).drop("_range", *names)
    first = F.col("_start") + F.coalesce(F.sum("_c").over(before_in_chunk(keys, "_v")), F.lit(0))
    held = held.withColumn("_first", first)
    holds = lambda at: (at >= F.col("_first")) & (at < F.col("_first") + F.col("_c"))
    hits = held.withColumn("p", F.explode(F.filter("_wanted", lambda p: holds(F.floor(spot(p))) | holds(F.ceil(spot(p))))))
    at = spot(F.col("p"))
    return (
        hits.groupBy(*keys, "p")
        .agg(
            F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias("_lo"),
            F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias("_hi"),
            F.max(at - F.floor(at)).alias("_f"),
        )
        .select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))
    )


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where two branches must see identical rows (row positions) and a
    recomputation after executor loss could order them differently.
    """
    return stored(df, scratch_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(
    df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), out: str = "idx"
) -> DataFrame:
    """Zero-based dense numbers following ``order`` inside each ``within`` group.

    Range sort plus per-partition offsets instead of one global window.
    ``within`` must have few distinct values (e.g. the encoded columns): the
    offset table has at most partitions + groups rows.
    """
    within = list(within)
    position_bits = 33
    placed = written_once(
        df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered"
    ).withColumns(
        {
            "_part": F.shiftright("_at", position_bits),
            "_pos": F.col("_at").bitwiseAND(F.lit((1 << position_bits) - 1)),
        }
    )
    runs = placed.groupBy(*within, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.select(*within, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(runs), [*within, "_part"])
    return numbered.withColumn(out, F.col("_start") + F.col("_pos") - F.col("_first")).select(*df.columns, out)


def positions(df: DataFrame, out: str = "position") -> DataFrame:
    """Zero-based numbers of the rows as they lie: partition by partition, in the order within each."""
    bits = 33
    placed = written_once(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumns({"_part": F.shiftright("_at", bits), "_pos": F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))  # one row a partition
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_pos")).select(*df.columns, out)
