"""Streaming operators reading ``events`` as a file stream (available-now trigger)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans.behaviour_queries import ASOF_SQL, ITEM_SQL, KINDS, asof
from rankloom.plans.registry import query, table
from rankloom.session import scratch_path
from rankloom.streaming import behaviour, learning
from rankloom.streaming.panes import HOUR_US, CounterGroup, PaneTable, stream_counter_groups, window_slots
from rankloom.streaming.versions import VersionedTable


#: slices of the table that arrive one after the other, and which events are held back to the last one
ARRIVALS, HELD_BACK = 6, 17


def arriving(spark, parts, run):
    """The parts arrive one after the other: each is written, however many files that takes, and ``run`` starts the
    stream anew from its checkpoint, so that one part is one micro-batch."""
    root = scratch_path(spark, "arrivals")
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/part={i}")
        run(spark.readStream.schema(part.schema).parquet(f"{root}/*")).awaitTermination()


def arriving_events(spark, sf_dir, run, held_back=False):
    """All events in six slices of time; ``held_back``: every 17th comes with the last one."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    width = F.lit((last - first) // ARRIVALS + 1)
    slot = F.floor((at - first) / width)
    if held_back:
        slot = F.when(F.col("event_id") % HELD_BACK == 0, ARRIVALS - 1).otherwise(slot)
    item = F.get_json_object("props", "$.k").cast("bigint")
    typed = lambda stream: stream.withColumns({"ts": F.col("ts").cast("timestamp"), "item": item})
    arriving(spark, [events.where(slot == i) for i in range(ARRIVALS)], lambda stream: run(typed(stream)))


#: the slice an event arrives in
PART_SQL = f"""((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))
  // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) // {ARRIVALS} + 1))"""


@query(
    "stream_behaviour_counters",
    f"""
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, user_id, {', '.join(f"count(*) FILTER (WHERE event_type = '{v}') AS {n}" for n, v in KINDS.items())}
FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def stream_behaviour_counters(spark, sf_dir):
    """Daily counters of the windows the watermark has closed."""
    path, checkpoint = scratch_path(spark, "counters"), scratch_path(spark, "ckpt")
    arriving_events(spark, sf_dir, lambda stream: behaviour.stream_behaviour_counters(stream, ["user_id"], KINDS, path, checkpoint))
    return spark.read.parquet(path).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "user_id", *KINDS)


@query(
    "stream_passtime",
    f"""
WITH l AS (SELECT user_id, event_type, CAST(floor((epoch_us({ASOF_SQL}) - epoch_us(max(ts))) / 60000000.0) AS BIGINT) AS minutes FROM events GROUP BY 1, 2)
SELECT user_id, event_type, minutes,
  CAST(CASE WHEN minutes < 1440 THEN floor(greatest(0, minutes) / 60.0) ELSE floor(least(129600, minutes) / 1440.0) + 23 END AS INTEGER) AS bucket FROM l""",
)
def stream_passtime(spark, sf_dir):
    root, checkpoint = scratch_path(spark, "last-seen"), scratch_path(spark, "ckpt")
    keys = ["user_id", "event_type"]
    arriving_events(spark, sf_dir, lambda stream: behaviour.stream_passtime(stream, keys, root, checkpoint, fold_every=2))
    return behaviour.read_elapsed(spark, root, keys, asof()).select(*keys, "minutes", "bucket")


@query(
    "stream_passtime_buckets",
    """
WITH w AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events),
 l AS (SELECT user_id, event_type, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1, 2),
 m AS (SELECT user_id, event_type, last_us, greatest(0, ((mark // 1000) * 1000 - last_us) // 60000000) AS minutes FROM l, w)
SELECT user_id, event_type, last_us, CAST(CASE WHEN minutes < 1440 THEN minutes // 60 ELSE least(129600, minutes) // 1440 + 23 END AS INTEGER) AS bucket FROM m""",
)
def stream_passtime_buckets(spark, sf_dir):
    """The elapsed-time bucket that each key has moved to, at the watermark after the last batch."""
    root, checkpoint = scratch_path(spark, "buckets"), scratch_path(spark, "ckpt")
    keys = ["user_id", "event_type"]
    arriving_events(spark, sf_dir, lambda stream: behaviour.stream_passtime(stream, keys, root, checkpoint))
    return behaviour.read_buckets(spark, root, keys)


@query(
    "stream_recent_sequence",
    f"""
WITH r AS (SELECT user_id, event_type, {ITEM_SQL} AS item, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
 k AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT k.user_id, k.event_type, CAST(p.pos AS INTEGER) AS pos, coalesce(r.item, 0) AS item
FROM k CROSS JOIN (SELECT unnest(generate_series(0, 19)) AS pos) p
LEFT JOIN r ON r.user_id = k.user_id AND r.event_type = k.event_type AND r.rn = p.pos + 1""",
)
def stream_recent_sequence(spark, sf_dir):
    root, checkpoint = scratch_path(spark, "recent"), scratch_path(spark, "ckpt")
    keys = ["user_id", "event_type"]
    run = lambda stream: behaviour.stream_recent_sequence(stream, keys, "item", 20, root, checkpoint, salts=2, fold_every=3)
    arriving_events(spark, sf_dir, run, held_back=True)
    out = behaviour.read_recent_sequence(spark, root, keys, 20)
    return out.select(*keys, F.posexplode("sequence").alias("pos", "item"))


@query(
    "stream_extend_dictionary",
    f"""
WITH v AS (
  SELECT 'event_type' AS col, trim(event_type) AS v, {PART_SQL} AS part FROM events
  UNION ALL SELECT 'item', CAST({ITEM_SQL} AS VARCHAR), {PART_SQL} FROM events),
 f AS (SELECT col, v, part, count(*) AS n, min(part) OVER (PARTITION BY col, v) AS first FROM v GROUP BY col, v, part)
SELECT col AS "column", v AS value, row_number() OVER (PARTITION BY col ORDER BY first, n DESC, v) - 1 AS idx FROM f WHERE part = first""",
)
def stream_extend_dictionary(spark, sf_dir):
    root, checkpoint = scratch_path(spark, "dictionary"), scratch_path(spark, "ckpt")
    arriving_events(spark, sf_dir, lambda stream: learning.stream_extend_dictionary(stream, ["event_type", "item"], root, checkpoint, fold_every=2))
    return learning.read_dictionary(spark, root).select("column", "value", "idx")


def _lr_sql() -> str:
    """One gradient step for each arriving slice, each from the weights of the one before."""
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for i in range(ARRIVALS):
        error = "1 / (1 + exp(-(a * x0 + b * x1 + c))) - y"
        grad = lambda x: f"0.5 * avg(({error}) * {x})"
        steps.append(
            f"w{i + 1} AS (SELECT any_value(a) - {grad('x0')} AS a, any_value(b) - {grad('x1')} AS b, any_value(c) - {grad('1')} AS c FROM s, w{i} WHERE part = {i})"
        )
    return f"""
WITH s AS (SELECT value / 100 AS x0, {ITEM_SQL} / 100.0 AS x1, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS y, {PART_SQL} AS part FROM events),
{', '.join(steps)}
SELECT round(a, 6) AS w0, round(b, 6) AS w1, round(c, 6) AS intercept FROM w{ARRIVALS}"""


@query("stream_train_lr", _lr_sql())
def stream_train_lr(spark, sf_dir):
    """A gradient step for each micro-batch, from the weights the one before has stored."""
    root, checkpoint = scratch_path(spark, "lr"), scratch_path(spark, "ckpt")
    x = F.array(F.col("value") / 100, F.col("item") / 100.0).alias("features")
    y = (F.col("event_type") == "click").cast("double").alias("label")
    arriving_events(spark, sf_dir, lambda stream: learning.stream_train_lr(stream.select(x, y), [0.0, 0.0], root, checkpoint, steps=1, step=0.5))
    w = F.col("weights")
    return VersionedTable(spark, root).latest().select(
        F.round(w[0], 6).alias("w0"), F.round(w[1], 6).alias("w1"), F.round("intercept", 6).alias("intercept")
    )


@query(
    "stream_moving_means",
    """SELECT CAST(i AS INTEGER) AS slot, round(avg(v), 6) AS value FROM (SELECT unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""",
)
def stream_moving_means(spark, sf_dir):
    """A first batch sets the statistics; later batches move them."""
    schema = table(spark, sf_dir, "embeddings").schema
    # as a pattern, since a stream takes the table's file or its folder only so
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{embeddings}}.parquet")
    root = scratch_path(spark, "means")
    learning.stream_moving_means(stream, "embedding", root, scratch_path(spark, "ckpt")).awaitTermination()
    return VersionedTable(spark, root).latest().select("slot", F.round("value", 6).alias("value"))


# ---- fixed widths of the realtime groups: 48, 15 and 36 slots; kinds and windows (hours) are ours -----
GROUPS = [
    CounterGroup("category", "category", ["view", "click", "signup", "purchase"], [1, 2, 3, 6, 12, 24, 48, 72, 120, 168, 336, 720]),
    CounterGroup("goods", "item", ["click", "signup", "purchase"], [1, 6, 24, 72, 168]),
    CounterGroup("user_group", "zone", ["view", "click", "signup", "purchase"], [1, 3, 6, 12, 24, 72, 168, 336, 720]),
]
# -------------------------------------------------------------------------------------------------------
KEY_SQL = {"category": f"CAST({ITEM_SQL} % 10 AS VARCHAR)", "goods": f"CAST({ITEM_SQL} AS VARCHAR)", "user_group": "CAST(user_id % 10 AS VARCHAR)"}
LONG_SQL = " UNION ALL ".join(f"SELECT '{g}' AS grp, {k} AS key, epoch_us(ts) // {HOUR_US} AS pane, event_type FROM events" for g, k in KEY_SQL.items())
ALL_KINDS = list(GROUPS[0].kinds)


def counter_panes(spark, sf_dir):
    zoned = {"category": F.col("item") % 10, "zone": F.col("user_id") % 10}
    root, checkpoint = scratch_path(spark, "panes"), scratch_path(spark, "ckpt")
    run = lambda stream: stream_counter_groups(stream.withColumns(zoned), GROUPS, root, checkpoint, fold_every=2)
    arriving_events(spark, sf_dir, run, held_back=True)
    return PaneTable(spark, root)


def late_included(panes, closed):
    """All counts: those of the panes and of the late rows, which are counted alike."""
    late = panes.counted(panes.late_rows(), GROUPS, "event_type", "ts")
    every = panes.read(closed).unionByName(late).groupBy("pane", "group", "key")
    return every.agg(*[F.sum(k).alias(k) for k in ALL_KINDS])


@query(
    "stream_counter_panes",
    f"""
WITH l AS ({LONG_SQL})
SELECT grp, key, pane, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ALL_KINDS)} FROM l
WHERE event_type IN ({', '.join(f"'{k}'" for k in ALL_KINDS)}) AND (pane + 1) * {HOUR_US} <= (SELECT epoch_us(max(ts)) - {HOUR_US} FROM events) GROUP BY 1, 2, 3""",
)
def stream_counter_panes(spark, sf_dir):
    """Closed panes of the three groups together with the late rows: every event once."""
    found = late_included(counter_panes(spark, sf_dir), closed=True)
    return found.select(F.col("group").alias("grp"), "key", "pane", *ALL_KINDS)


@query(
    "stream_late_rows",
    f"""
WITH e AS (SELECT *, {PART_SQL} AS part, epoch_us(ts) AS us FROM events),
 w AS (SELECT max(us) - {HOUR_US} AS mark FROM e WHERE part < {ARRIVALS - 1} AND event_id % {HELD_BACK} > 0)
SELECT event_id, user_id, event_type FROM e, w WHERE event_id % {HELD_BACK} = 0 AND part < {ARRIVALS - 1} AND (us // {HOUR_US} + 1) * {HOUR_US} <= mark""",
)
def stream_late_rows(spark, sf_dir):
    """The events that came after their pane was closed, stored as they came."""
    return counter_panes(spark, sf_dir).late_rows().select("event_id", "user_id", "event_type")


def _slots_sql() -> str:
    asof = f"(SELECT epoch_us(max(ts)) // {HOUR_US} + 1 FROM events)"
    parts = []
    for g in GROUPS:
        slots = ", ".join(
            f"count(*) FILTER (WHERE event_type = '{k}' AND pane >= {asof} - {w})" for k in g.kinds for w in g.windows
        )
        parts.append(
            f"SELECT '{g.name}' AS grp, key, unnest([{slots}]) AS value, unnest(range({g.width})) AS slot FROM l "
            f"WHERE grp = '{g.name}' AND event_type IN ({', '.join(repr(k) for k in ALL_KINDS)}) AND pane >= {asof} - {max(g.windows)} GROUP BY key"
        )
    return f"WITH l AS ({LONG_SQL}) SELECT grp, key, CAST(slot AS INTEGER) AS slot, CAST(value AS BIGINT) AS value FROM ({' UNION ALL '.join(parts)})"


@query("stream_counter_slots", _slots_sql())
def stream_counter_slots(spark, sf_dir):
    """The 48, 15 and 36 realtime slots of every key after the last batch, late rows included."""
    panes = late_included(counter_panes(spark, sf_dir), closed=False)
    mark = table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    found = None
    for g in GROUPS:
        rows = window_slots(panes, g, F.lit(mark // HOUR_US + 1)).select(
            F.lit(g.name).alias("grp"), "key", F.posexplode("slots").alias("slot", "value")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def _moving_cov_sql() -> str:
    """Three arriving parts of the embeddings; each moves what the ones before have left."""
    part = "vec_id * 3 // (SELECT max(vec_id) + 1 FROM embeddings)"
    long = f"(SELECT vec_id, {part} AS part, unnest(generate_series(0, 63)) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
    moved = lambda x: f"0.9 * (0.9 * {x(0)} + 0.1 * {x(1)}) + 0.1 * {x(2)}"
    eye = "CASE WHEN x.c = y.c THEN 0.001 ELSE 0 END"
    cov = moved(lambda k: f"(0.999 * covar_samp(x.v, y.v) FILTER (WHERE x.part = {k}) + {eye})")
    mean = moved(lambda k: f"avg(v) FILTER (WHERE part = {k})")
    return f"""
WITH a AS {long}
SELECT CAST(x.c // 16 AS INTEGER) AS grp, CAST(x.c % 16 AS INTEGER) AS i, CAST(y.c % 16 AS INTEGER) AS j, round({cov}, 6) + 0.0 AS value
FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.c // 16 = y.c // 16 GROUP BY x.c, y.c
UNION ALL SELECT CAST(c // 16 AS INTEGER), CAST(c % 16 AS INTEGER), -1, round({mean}, 6) + 0.0 FROM a GROUP BY c"""


@query("stream_moving_covariance", _moving_cov_sql())
def stream_moving_covariance(spark, sf_dir):
    """Moving means and covariances over three micro-batches."""
    rows = table(spark, sf_dir, "embeddings")
    top = rows.agg(F.max("vec_id") + 1).first()[0]
    state, checkpoint = scratch_path(spark, "covariance"), scratch_path(spark, "ckpt")
    parts = [rows.where(F.floor(F.col("vec_id") * 3 / top) == k) for k in range(3)]
    arriving(spark, parts, lambda stream: learning.stream_moving_covariance(stream, "embedding", 16, state, checkpoint, 0.9))
    return VersionedTable(spark, state).latest().select("grp", "i", "j", (F.round("value", 6) + 0.0).alias("value"))
