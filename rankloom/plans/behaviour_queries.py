"""Behaviour features over ``events``.

Stand-in kinds: imp = view, click = click, cart = signup, buy = purchase;
item = props.k; windows end at 2024-01-31.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from rankloom.operators import behaviour as bh
from rankloom.operators.daily_counts import RollingCounts
from rankloom.plans.contract import HORIZONS, LONG_LENGTH, SHORT_LENGTH, TOTAL_HORIZONS
from rankloom.plans.registry import query, table
from rankloom.session import scratch_path

ASOF_TEXT = "2024-01-31 00:00:00"
KINDS = {"imp": "view", "click": "click", "cart": "signup", "buy": "purchase"}
ITEM_SQL = "CAST(json_extract(props, '$.k') AS BIGINT)"
ASOF_SQL = f"TIMESTAMP '{ASOF_TEXT}'"


def asof():
    return F.lit(ASOF_TEXT).cast("timestamp_ntz")


def behaviour_log(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k").cast("bigint"))


def _counts_sql(keys: dict[str, str]) -> str:
    parts = []
    for h in HORIZONS:
        recent = f"ts >= {ASOF_SQL} - INTERVAL {h} DAY"
        base = f"count(*) FILTER (WHERE event_type = 'view' AND {recent})"
        for n, v in KINDS.items():
            c = f"count(*) FILTER (WHERE event_type = '{v}' AND {recent})"
            parts.append(f"{c} AS {n}_{h}d")
            if n != "imp":
                parts.append(f"round(CASE WHEN {base} > 0 THEN CAST({c} AS DOUBLE) / {base} ELSE 0 END, 9) AS {n}_rate_{h}d")
    select = ", ".join(f"{v} AS {k}" for k, v in keys.items())
    group = ", ".join(str(i + 1) for i in range(len(keys)))
    return f"""SELECT {select}, {', '.join(parts)} FROM events
WHERE ts < {ASOF_SQL} AND ts >= {ASOF_SQL} - INTERVAL {max(HORIZONS)} DAY AND event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY {group}"""


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if "_rate_" in c else F.col(c) for c in df.columns])


@query("windowed_counts_user_item", _counts_sql({"user_id": "user_id", "item": ITEM_SQL}))
def windowed_counts_user_item(spark, sf_dir):
    return _rounded(bh.windowed_counts(behaviour_log(spark, sf_dir), ["user_id", "item"], KINDS, asof()))


@query("windowed_counts_zone_item", _counts_sql({"zone": "user_id % 10", "item": ITEM_SQL}))
def windowed_counts_zone_item(spark, sf_dir):
    log = behaviour_log(spark, sf_dir).withColumn("zone", F.col("user_id") % 10)
    return _rounded(bh.windowed_counts(log, ["zone", "item"], KINDS, asof()))


def _totals_sql() -> str:
    parts = []
    for h in TOTAL_HORIZONS:
        recent = f"ts >= {ASOF_SQL} - INTERVAL {h} DAY"
        parts += [f"count(*) FILTER (WHERE event_type = '{v}' AND {recent}) AS {n}_{h}d" for n, v in KINDS.items()]
        parts.append(f"round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase' AND {recent}), 0), 4) AS value_{h}d")
    return f"""SELECT {ITEM_SQL} AS item, {', '.join(parts)} FROM events
WHERE ts < {ASOF_SQL} AND ts >= {ASOF_SQL} - INTERVAL {max(TOTAL_HORIZONS)} DAY AND event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1"""


@query("horizon_totals", _totals_sql())
def horizon_totals(spark, sf_dir):
    out = bh.horizon_totals(behaviour_log(spark, sf_dir), ["item"], KINDS, asof(), "value", "purchase")
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("value_") else F.col(c) for c in out.columns])


def _flags_sql() -> str:
    parts = [
        f"max(CASE WHEN event_type = '{v}' AND ts >= {ASOF_SQL} - INTERVAL {h} DAY THEN 1 ELSE 0 END) AS is_{n}_{h}d"
        for n, v in (("order", "purchase"), ("cart", "signup"))
        for h in (1, 7)
    ]
    return f"""SELECT user_id, {ITEM_SQL} AS item, {', '.join(parts)} FROM events
WHERE ts < {ASOF_SQL} AND ts >= {ASOF_SQL} - INTERVAL 7 DAY AND event_type IN ('purchase', 'signup') GROUP BY 1, 2"""


@query("pair_flags", _flags_sql())
def pair_flags(spark, sf_dir):
    kinds = {"order": "purchase", "cart": "signup"}
    return bh.pair_flags(behaviour_log(spark, sf_dir), ["user_id", "item"], kinds, asof())


@query(
    "hour_week_profile",
    "SELECT user_id, "
    + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS hour_{h}" for h in range(24))
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE isodow(ts) - 1 = {d}) AS week_{d}" for d in range(7))
    + ", "
    + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{k}') AS order_type_{i}" for i, k in enumerate(("purchase", "signup", "click"))
    )
    + " FROM events GROUP BY 1",
)
def hour_week_profile(spark, sf_dir):
    return bh.hour_week_profile(table(spark, sf_dir, "events"), ["user_id"], order_kinds=("purchase", "signup", "click"))


def _sequence_sql(n: int) -> str:
    return f"""
WITH r AS (SELECT user_id, event_type, {ITEM_SQL} AS item, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
 k AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT k.user_id, k.event_type, CAST(p.pos AS INTEGER) AS pos, coalesce(r.item, 0) AS item
FROM k CROSS JOIN (SELECT unnest(generate_series(0, {n - 1})) AS pos) p
LEFT JOIN r ON r.user_id = k.user_id AND r.event_type = k.event_type AND r.rn = p.pos + 1"""


def _sequence(spark, sf_dir, n):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    out = bh.behaviour_sequence(behaviour_log(spark, sf_dir), ["user_id", "event_type"], "item", n, order)
    return out.select("user_id", "event_type", F.posexplode("sequence").alias("pos", "item"))


@query("behaviour_sequence_long", _sequence_sql(LONG_LENGTH))
def behaviour_sequence_long(spark, sf_dir):
    return _sequence(spark, sf_dir, LONG_LENGTH)


@query("behaviour_sequence_short", _sequence_sql(SHORT_LENGTH))
def behaviour_sequence_short(spark, sf_dir):
    return _sequence(spark, sf_dir, SHORT_LENGTH)


@query(
    "quantile_bucketize",
    """
WITH q AS (SELECT quantile_cont(l_extendedprice, list_transform(generate_series(1, 15), lambda i: i / 16.0)) AS c FROM lineitem)
SELECT CAST(len(list_filter(q.c, lambda x: x <= l_extendedprice)) AS INTEGER) AS bucket, count(*) AS n,
       min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem, q GROUP BY 1""",
)
def quantile_bucketize(spark, sf_dir):
    out = bh.quantile_bucketize(table(spark, sf_dir, "lineitem"), "l_extendedprice", 16, exact=True)
    return out.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest")
    )


@query(
    "context_features",
    """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS week, CAST(hour(ts) AS INTEGER) AS hour,
       CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_week FROM events""",
)
def context_features(spark, sf_dir):
    return bh.context_features(table(spark, sf_dir, "events")).select("event_id", "week", "hour", "is_week")


@query(
    "passtime",
    f"""
WITH l AS (SELECT user_id, event_type, CAST(floor((epoch_us({ASOF_SQL}) - epoch_us(max(ts))) / 60000000.0) AS BIGINT) AS minutes
           FROM events WHERE ts < {ASOF_SQL} GROUP BY 1, 2)
SELECT user_id, event_type, minutes,
  CAST(CASE WHEN minutes < 1440 THEN floor(minutes / 60.0) ELSE floor(least(129600, minutes) / 1440.0) + 23 END AS INTEGER) AS bucket FROM l""",
)
def passtime(spark, sf_dir):
    out = bh.passtime(table(spark, sf_dir, "events"), ["user_id", "event_type"], asof())
    return out.select("user_id", "event_type", "minutes", "bucket")


@query(
    "gap_minutes",
    """SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 60000000.0) AS BIGINT) AS gap FROM events""",
)
def gap_minutes(spark, sf_dir):
    out = bh.gap_minutes(table(spark, sf_dir, "events"), ["user_id", "event_type"], tie=["event_id"])
    return out.select("event_id", "gap")


#: days rolled one by one before the windows end
ROLLED, ROLL_HORIZONS = 20, [1, 3, 7, 14, 30]
_ROLLED_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE event_type = '{v}' AND ts >= {ASOF_SQL} - INTERVAL {h} DAY) AS {n}_{h}d" for h in ROLL_HORIZONS for n, v in KINDS.items()
)


@query(
    "rolled_counts",
    f"""SELECT user_id, {_ROLLED_COUNTS} FROM events
WHERE ts < {ASOF_SQL} AND ts >= {ASOF_SQL} - INTERVAL 30 DAY AND event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1""",
)
def rolled_counts(spark, sf_dir):
    """Counts that were moved day by day for twenty days; each step reads the events of its day alone."""
    events = table(spark, sf_dir, "events")
    counts = RollingCounts(spark, scratch_path(spark, "rolled"), ["user_id"], KINDS, ROLL_HORIZONS)
    last = date.fromisoformat(ASOF_TEXT[:10]) - timedelta(days=1)
    first = last - timedelta(days=ROLLED)
    for back in range(max(ROLL_HORIZONS)):
        if last - timedelta(days=back) <= first:
            counts.count_day(events, last - timedelta(days=back))
    counts.rebuild(first)
    for k in range(1, ROLLED + 1):
        rolled = counts.roll(events, first + timedelta(days=k))
    return rolled.select("user_id", *[F.col(n).cast("bigint").alias(n) for n in counts.names()])
