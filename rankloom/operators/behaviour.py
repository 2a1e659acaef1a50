"""Counters, profiles and sequences computed from a behaviour log.

The log has one row per event: keys (user, item, zone ...), a kind and a time.
Windows end at ``asof`` (exclusive) and start ``h`` days earlier (inclusive).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.functions.scalars import bucket_elapsed
from rankloom.operators.chunks import exact_quantiles, quantile_cuts
from rankloom.plans.contract import HORIZONS, TOTAL_HORIZONS


def _since(asof: Column, days: int) -> Column:
    return asof - F.make_interval(days=F.lit(days))


def _recent(events: DataFrame, ts: str, asof: Column, days: int) -> DataFrame:
    """One time range bounded by the longest horizon; reaches the scan as a pushed filter."""
    return events.where((F.col(ts) >= _since(asof, days)) & (F.col(ts) < asof))


def windowed_counts(
    events: DataFrame,
    keys: Sequence[str],
    kinds: dict[str, str],
    asof: Column,
    kind: str = "event_type",
    ts: str = "ts",
    horizons: Sequence[int] = tuple(HORIZONS),
    base: str = "imp",
) -> DataFrame:
    """Counts per horizon and kind plus rates against the ``base`` kind, in one scan and one shuffle.

    ``kinds`` maps an output name to an event type.  A rate without any base
    event is 0.
    """
    require_columns(events, [*keys, kind, ts])
    log = _recent(events, ts, asof, max(horizons)).where(F.col(kind).isin(list(kinds.values())))
    counts = [
        F.count_if((F.col(kind) == F.lit(v)) & (F.col(ts) >= _since(asof, h))).alias(f"{n}_{h}d")
        for h in horizons
        for n, v in kinds.items()
    ]
    out = log.groupBy(*keys).agg(*counts)
    rates = {
        f"{n}_rate_{h}d": F.when(F.col(f"{base}_{h}d") > 0, F.col(f"{n}_{h}d") / F.col(f"{base}_{h}d")).otherwise(0.0)
        for h in horizons
        for n in kinds
        if n != base
    }
    return out.withColumns(rates)


def horizon_totals(
    events: DataFrame,
    keys: Sequence[str],
    kinds: dict[str, str],
    asof: Column,
    amount: str | None = None,
    amount_kind: str | None = None,
    kind: str = "event_type",
    ts: str = "ts",
    horizons: Sequence[int] = tuple(TOTAL_HORIZONS),
) -> DataFrame:
    """Counts per horizon and kind, and the summed ``amount`` of one kind, in one scan."""
    require_columns(events, [*keys, kind, ts])
    log = _recent(events, ts, asof, max(horizons)).where(F.col(kind).isin(list(kinds.values())))
    aggregates = []
    for h in horizons:
        inside = F.col(ts) >= _since(asof, h)
        aggregates += [F.count_if((F.col(kind) == F.lit(v)) & inside).alias(f"{n}_{h}d") for n, v in kinds.items()]
        if amount:
            wanted = inside if amount_kind is None else inside & (F.col(kind) == F.lit(amount_kind))
            aggregates.append(F.sum(F.when(wanted, F.col(amount)).otherwise(F.lit(0.0))).alias(f"{amount}_{h}d"))
    return log.groupBy(*keys).agg(*aggregates)


def pair_flags(
    events: DataFrame,
    keys: Sequence[str],
    kinds: dict[str, str],
    asof: Column,
    kind: str = "event_type",
    ts: str = "ts",
    horizons: Sequence[int] = (1, 7),
) -> DataFrame:
    """1 when the pair had an event of the kind within the horizon, else 0."""
    log = _recent(events, ts, asof, max(horizons)).where(F.col(kind).isin(list(kinds.values())))
    flags = [
        F.max(((F.col(kind) == F.lit(v)) & (F.col(ts) >= _since(asof, h))).cast("int")).alias(f"is_{n}_{h}d")
        for n, v in kinds.items()
        for h in horizons
    ]
    return log.groupBy(*keys).agg(*flags)


def hour_week_profile(
    events: DataFrame, keys: Sequence[str], kind: str = "event_type", ts: str = "ts", order_kinds: Sequence[str] = ()
) -> DataFrame:
    """24 hour counts, 7 weekday counts (0 = Monday) and one count per order kind."""
    hours = [F.count_if(F.hour(ts) == h).alias(f"hour_{h}") for h in range(24)]
    days = [F.count_if(F.weekday(ts) == d).alias(f"week_{d}") for d in range(7)]
    orders = [F.count_if(F.col(kind) == k).alias(f"order_type_{i}") for i, k in enumerate(order_kinds)]
    return events.groupBy(*keys).agg(*hours, *days, *orders)


def behaviour_sequence(
    events: DataFrame,
    keys: Sequence[str],
    item: str,
    n: int,
    order: Sequence[Column],
    out: str = "sequence",
) -> DataFrame:
    """Latest ``n`` item ids per key, newest first, padded with 0 on the right.

    ``order`` sorts newest first and must be total.  The row limit is pushed
    below the shuffle, so at most n rows per key and task are moved.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    latest = events.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n)
    packed = latest.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_rn", F.col(item).cast("bigint").alias("_id")))).alias("_s")
    )
    ids = F.transform("_s", lambda s: s["_id"])
    padding = F.array_repeat(F.lit(0).cast("bigint"), F.lit(n) - F.size("_s"))
    return packed.select(*keys, F.concat(ids, padding).alias(out))


def quantile_bucketize(
    df: DataFrame, column: str, buckets: int, out: str = "bucket", exact: bool = False
) -> DataFrame:
    """Equal-frequency buckets 0..n-1; only the cut points reach the driver.

    ``exact`` uses interpolated percentiles, otherwise sketched ones (see
    ``quantile_cuts``).  A value equal to a cut point belongs to the upper bucket.
    """
    if exact:
        wanted = [i / buckets for i in range(1, buckets)]
        rows = exact_quantiles(df, column, wanted).select("value").collect()  # buckets - 1 rows
        cuts = sorted({float(r[0]) for r in rows})
    else:
        cuts = sorted({c for c in quantile_cuts(df, column, buckets) if abs(c) != float("inf")})
    if len(cuts) == 0:
        return df.withColumn(out, F.when(F.col(column).isNotNull(), F.lit(0)))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_b_in", outputCol="_b_out", handleInvalid="keep").transform(
        df.withColumn("_b_in", F.col(column).cast("double"))
    )
    return bucketed.withColumn(out, F.col("_b_out").cast("int")).drop("_b_in", "_b_out")


def context_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Weekday (0 = Monday), hour, and 1 on weekends."""
    week = F.weekday(ts)
    return df.withColumns({"week": week, "hour": F.hour(ts), "is_week": (week >= 5).cast("int")})


def elapsed_minutes(earlier: Column, later: Column) -> Column:
    """Whole minutes between two timestamps, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(60_000_000))


def passtime(
    events: DataFrame, keys: Sequence[str], asof: Column, ts: str = "ts"
) -> DataFrame:
    """Minutes from the latest event of each key to ``asof``, with the elapsed-time bucket."""
    last = events.where(F.col(ts) < asof).groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    return last.withColumn("minutes", elapsed_minutes(F.col("last_ts"), asof)).withColumn(
        "bucket", bucket_elapsed(F.col("minutes"))
    )


def gap_minutes(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), slice_unit: str = "hour"
) -> DataFrame:
    """Minutes since the previous event of the same key, for every event (first event: NULL).

    Rows are ordered per (key, time slice); only the last time of each slice
    is carried across slices, so one very active key is spread over tasks.
    """
    sliced = events.withColumn("_slice", F.date_trunc(slice_unit, F.col(ts).cast("timestamp")))
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, *tie)
    ends = sliced.groupBy(*keys, "_slice").agg(F.max(ts).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.select(*keys, "_slice", F.lag("_end").over(across).alias("_carried"))
    joined = sliced.withColumn("_prev", F.lag(ts).over(inside)).join(carried, [*keys, "_slice"], "left")
    gap = elapsed_minutes(F.coalesce("_prev", "_carried"), F.col(ts))
    return joined.select(*events.columns, gap.alias("gap"))
