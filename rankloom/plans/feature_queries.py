"""Feature-contract operators over ``embeddings`` (64 values per row) and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import arrays, scalars
from rankloom.operators import features
from rankloom.plans import contract as fixed
from rankloom.plans.contract import FeatureContract
from rankloom.plans.registry import query, table

WIDTH = FeatureContract().width
COPIES = -(-WIDTH // 64)

# every row's 64 values repeated up to the contract width, as exact integers
WIDE_SQL = f"""(SELECT vec_id, list_transform(flatten([embedding for i in range({COPIES})])[1:{WIDTH}],
  lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS inputs FROM embeddings)"""


def wide_inputs(spark, sf_dir):
    """984 integer slots per embedding row: floor(1000 * value), repeated."""
    copies = F.slice(F.flatten(F.array_repeat(F.col("embedding"), COPIES)), 1, WIDTH)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(copies, lambda v: F.floor(v.cast("double") * 1000).cast("bigint")).alias("inputs")
    )


def _positions(df, column, out="v"):
    return df.select("vec_id", F.posexplode(column).alias("pos", out))


FIELD_STARTS = dict(zip([n for n, _ in fixed.INPUT_FIELDS], arrays.offsets_of([w for _, w in fixed.INPUT_FIELDS])))


@query(
    "slice_features",
    "\nUNION ALL\n".join(
        f"""SELECT vec_id, '{n}' AS field, {w} AS width, CAST(list_sum(inputs[{s + 1}:{s + w}]) AS BIGINT) AS total FROM w"""
        for (n, w), s in zip(fixed.INPUT_FIELDS, FIELD_STARTS.values())
    ).join([f"WITH w AS {WIDE_SQL}\n", ""]),
)
def slice_features(spark, sf_dir):
    sliced = features.slice_features(wide_inputs(spark, sf_dir), "inputs", fixed.INPUT_FIELDS)
    total = lambda n: F.aggregate(F.col(n), F.lit(0).cast("bigint"), lambda s, v: s + v)
    rows = F.array(
        *[F.struct(F.lit(n).alias("field"), F.size(n).alias("width"), total(n).alias("total")) for n, _ in fixed.INPUT_FIELDS]
    )
    return sliced.select("vec_id", F.explode(rows).alias("r")).select("vec_id", "r.*")


@query(
    "concat_features",
    f"""
WITH w AS {WIDE_SQL},
 c AS (SELECT vec_id, list_concat(list_concat(inputs[151:154], inputs[891:893]), inputs[155:174]) AS v FROM w)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(v[i] AS DOUBLE) AS v FROM (SELECT vec_id, v, unnest(generate_series(1, 27)) AS i FROM c)""",
)
def concat_features(spark, sf_dir):
    sliced = features.slice_features(wide_inputs(spark, sf_dir), "inputs", fixed.INPUT_FIELDS)
    out = features.concat_features(sliced, ["features_pair_4", "context_feature", "goods_sparse_features"], "merged")
    return _positions(out, "merged").withColumn("v", F.col("v").cast("double"))


_REALTIME_SQL = f"""
WITH w AS {WIDE_SQL},
 p AS (SELECT vec_id, i - 1 AS slot, inputs[i] AS x FROM (SELECT vec_id, inputs, unnest(generate_series(1, 150)) AS i FROM w)),
 b AS (SELECT vec_id, slot, CAST(x AS DOUBLE) AS x FROM p)
SELECT vec_id, 'realtime_pair_click' AS part, CAST(0 AS INTEGER) AS pos, CAST(greatest(0, least(2, x)) AS BIGINT) AS id FROM b WHERE slot = 5
UNION ALL SELECT vec_id, 'realtime_back_category', CAST(slot - 30 AS INTEGER), CAST(floor(greatest(0, least(29, x)) / 5) AS BIGINT) + 10 * (slot - 30) FROM b WHERE slot BETWEEN 30 AND 77
UNION ALL SELECT vec_id, 'realtime_goods', CAST(slot - 78 AS INTEGER), CAST(least(30, floor(ln(greatest(0, least(100000000, x)) + 1))) AS BIGINT) + 32 * (slot - 78) FROM b WHERE slot BETWEEN 78 AND 92
UNION ALL SELECT vec_id, 'realtime_passtime', CAST(slot - 93 AS INTEGER),
  CAST(CASE WHEN greatest(0, least(129600, x)) < 1440 THEN floor(greatest(0, x) / 60) ELSE floor(least(129600, x) / 1440) + 23 END AS BIGINT) + 114 * (slot - 93) FROM b WHERE slot BETWEEN 93 AND 113
UNION ALL SELECT vec_id, 'realtime_user_group', CAST(slot - 114 AS INTEGER), CAST(least(30, floor(ln(greatest(0, least(129600, x)) + 1))) AS BIGINT) + 32 * (slot - 114) FROM b WHERE slot BETWEEN 114 AND 149"""


@query("process_realtime", _REALTIME_SQL)
def process_realtime(spark, sf_dir):
    wide = wide_inputs(spark, sf_dir)
    parts = wide.select("vec_id", *features.process_realtime(F.slice("inputs", 1, 150)))
    single = F.array(F.col("realtime_pair_click").cast("bigint"))
    named = [("realtime_pair_click", single)] + [
        (n, F.col(n)) for n in ("realtime_back_category", "realtime_goods", "realtime_passtime", "realtime_user_group")
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("part"), c.alias("ids")) for n, c in named])
    return (
        parts.select("vec_id", F.inline(rows))
        .select("vec_id", "part", F.posexplode("ids").alias("pos", "id"))
    )


@query(
    "process_context",
    f"""
WITH w AS {WIDE_SQL}
SELECT vec_id, inputs[891] AS week_id, inputs[892] + 10 AS hour_id FROM w""",
)
def process_context(spark, sf_dir):
    wide = wide_inputs(spark, sf_dir)
    out = features.process_context(F.slice("inputs", FIELD_STARTS["context_feature"] + 1, 3))
    return wide.select("vec_id", out.alias("c")).select("vec_id", F.col("c")[0].alias("week_id"), F.col("c")[1].alias("hour_id"))


_SPARSE_START = FIELD_STARTS["goods_sparse_features"]


def _sparse_sql() -> str:
    where = {n: _SPARSE_START + i + 1 for i, n in enumerate(fixed.SPARSE_ID_NAMES)}
    sizes = [fixed.VOCABULARY[v] for _, v in fixed.SPARSE_CONCATENATED]
    parts, start = [], 0
    for i, ((n, v), size) in enumerate(zip(fixed.SPARSE_CONCATENATED, sizes)):
        ident = f"greatest(0, least({size - 1}, inputs[{where[n]}]))"
        parts.append(f"greatest(0, least({sum(sizes) - 1}, {ident} + {start})) AS g{i}")
        start += size
    for n, v in fixed.SPARSE_SEPARATE:
        parts.append(f"greatest(0, least({fixed.VOCABULARY[v] - 1}, inputs[{where[n]}])) AS {v}")
    return f"WITH w AS {WIDE_SQL} SELECT vec_id, {', '.join(parts)} FROM w"


@query("select_sparse_ids", _sparse_sql())
def select_sparse_ids(spark, sf_dir):
    ids = wide_inputs(spark, sf_dir).select("vec_id", F.slice("inputs", _SPARSE_START + 1, 20).alias("ids"))
    out = features.select_sparse_ids(ids, "ids")
    return out.select(
        "vec_id", *[F.col("goods_sparse")[i].alias(f"g{i}") for i in range(8)], "cspu_idx", "supplier_idx", "level2_idx"
    )


def _sequence_sql() -> str:
    base, start, parts = FIELD_STARTS["sequence"], 0, []
    for n, w, v in fixed.SEQUENCE_SEGMENTS:
        if v is not None:
            cut = f"inputs[{base + start + 1}:{base + start + w}]"
            top = fixed.VOCABULARY[v] - 1
            parts.append(
                f"""SELECT vec_id, '{n}' AS segment, {w} AS width, CAST(list_sum(list_transform({cut}, lambda x: greatest(0, least({top}, x)))) AS BIGINT) AS total,
  len(list_filter({cut}, lambda x: x > 0)) AS valid FROM w"""
            )
        start += w
    return f"WITH w AS {WIDE_SQL}\n" + "\nUNION ALL ".join(parts)


@query("split_sequence", _sequence_sql())
def split_sequence(spark, sf_dir):
    seq = wide_inputs(spark, sf_dir).select("vec_id", F.slice("inputs", FIELD_STARTS["sequence"] + 1, 350).alias("seq"))
    out = features.split_sequence(seq, "seq")
    names = [n for n, _, v in fixed.SEQUENCE_SEGMENTS if v is not None]
    total = lambda n: F.aggregate(F.col(n), F.lit(0).cast("bigint"), lambda s, v: s + v)
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("segment"),
                F.size(n).alias("width"),
                total(n).alias("total"),
                arrays.valid_length(F.col(n)).cast("bigint").alias("valid"),
            )
            for n in names
        ]
    )
    return out.select("vec_id", F.inline(rows))


@query(
    "sequence_mask",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN v > 0 THEN 1 ELSE 0 END AS pooled, CASE WHEN v <> 0 THEN 1 ELSE 0 END AS attended
FROM (SELECT vec_id, unnest(generate_series(1, 64)) AS i, floor(CAST(unnest(embedding) AS DOUBLE) * 4) AS v FROM embeddings)""",
)
def sequence_mask(spark, sf_dir):
    seq = F.transform("embedding", lambda v: F.floor(v.cast("double") * 4))
    masks = F.arrays_zip(
        arrays.sequence_mask(seq).alias("pooled"), arrays.sequence_mask(seq, strict_positive=False).alias("attended")
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(masks).alias("pos", "m"))
    return rows.select("vec_id", "pos", "m.*")


def _offset_sql() -> str:
    dims = [10 + 3 * i for i in range(64)]
    starts = arrays.offsets_of(dims)
    return f"""
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(greatest(0, least({sum(dims) - 1}, floor(v * 20) + o)) AS BIGINT) AS id
FROM (SELECT vec_id, unnest(generate_series(1, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, unnest({starts}) AS o FROM embeddings)"""


@query("offset_encode", _offset_sql())
def offset_encode(spark, sf_dir):
    dims = [10 + 3 * i for i in range(64)]
    ids = F.transform("embedding", lambda v: F.floor(v.cast("double") * 20))
    rows = table(spark, sf_dir, "embeddings").withColumn("ids", features.process_bucket_group(ids, dims))
    return _positions(rows, "ids", "id")


BUCKET_GROUPS = {
    "bucket_user": 66,
    "bucket_goods": 49,
    "bucket_pair": 14,
    "bucket_user_cspu": 28,
    "bucket_ozid_cspu": 28,
    "bucket_user_behavior": 34,
    "bucket_goods_gross": 1,
}


def rule_contract() -> FeatureContract:
    """The contract with bucket vocabularies from a rule: slot i of a group has 20 + i values."""
    groups = {g: {f"{g}_{i}": 20 + i for i in range(n)} for g, n in BUCKET_GROUPS.items()}
    contract = FeatureContract()
    contract.dims.update(groups)
    contract.names.update({g: list(d) for g, d in groups.items()})
    return contract


def _inputs_sql() -> str:
    parts = []
    start = FIELD_STARTS["features_pair_4"]
    pair_top = sum(fixed.VOCABULARY[n] for n in fixed.PAIR_NAMES) - 1
    parts.append(f"SELECT vec_id, 'pair' AS part, unnest(generate_series(0, 3)) AS pos, unnest(list_transform(inputs[{start + 1}:{start + 4}], lambda x: CAST(greatest(0, least({pair_top}, x)) AS DOUBLE))) AS v FROM w")
    for field, slots in fixed.BUCKET_SLOTS.items():
        group, base = field.removesuffix("_features"), FIELD_STARTS[field]
        dims = [20 + i for i in range(BUCKET_GROUPS[group])]
        cut = " || ".join(f"inputs[{base + s + 1}:{base + s + n}]" for s, n in slots)
        parts.append(f"""SELECT vec_id, '{group}_obj', unnest(generate_series(0, {len(dims) - 1})),
  unnest(list_transform(list_zip({cut}, {arrays.offsets_of(dims)}), lambda t: CAST(greatest(0, least({sum(dims) - 1}, t[1] + t[2])) AS DOUBLE))) FROM w""")
        if field in fixed.CONTINUOUS_START:
            first = fixed.CONTINUOUS_START[field]
            width = dict(fixed.INPUT_FIELDS)[field]
            parts.append(f"SELECT vec_id, '{group}_raw', unnest(generate_series(0, {width - first - 1})), unnest(list_transform(inputs[{base + first + 1}:{base + width}], lambda x: CAST(greatest(0, least(1, x)) AS DOUBLE))) FROM w")
    body = "\nUNION ALL ".join(parts)
    return f"WITH w AS {WIDE_SQL}, p AS ({body}) SELECT vec_id, part, count(*) AS n, round(sum(v), 4) AS total, round(sum(v * (pos + 1)), 4) AS weighted FROM p GROUP BY 1, 2"


@query("process_inputs", _inputs_sql())
def process_inputs(spark, sf_dir):
    out = features.process_inputs(wide_inputs(spark, sf_dir), "inputs", rule_contract())
    names = ["pair", *[f"{g}_obj" for g in BUCKET_GROUPS], "bucket_user_raw", "bucket_goods_raw"]
    rows = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).cast("array<double>").alias("values")) for n in names])
    long = out.select("vec_id", F.inline(rows)).select("vec_id", "part", F.posexplode("values").alias("pos", "v"))
    return long.groupBy("vec_id", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("v"), 4).alias("total"),
        F.round(F.sum(F.col("v") * (F.col("pos") + 1)), 4).alias("weighted"),
    )


@query(
    "continuous_slots",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, greatest(0, least(1, v)) AS v
FROM (SELECT vec_id, i, CAST(embedding[i + 24] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 40)) AS i FROM embeddings))""",
)
def continuous_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("raw", features.continuous_slots(F.col("embedding"), 24, 40))
    return _positions(rows, "raw")


@query(
    "clip_columns",
    """SELECT event_id, greatest(10.0, least(100.0, value)) AS value,
       CASE WHEN event_type = 'view' THEN greatest(10.0, least(100.0, value)) END AS view_value FROM events""",
)
def clip_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "value", F.when(F.col("event_type") == "view", F.col("value")).alias("view_value")
    )
    return features.clip_columns(rows, ["value", "view_value"], 10.0, 100.0)


@query(
    "bucket_functions",
    """
SELECT event_id, CAST(floor(greatest(0, least(29, value)) / 5) AS INTEGER) AS width_bucket,
  CAST(least(30, floor(ln(value + 1))) AS INTEGER) AS log_bucket,
  CAST(CASE WHEN least(129600, value * 100) < 1440 THEN floor(value * 100 / 60) ELSE floor(least(129600, value * 100) / 1440) + 23 END AS INTEGER) AS elapsed_bucket,
  CAST(greatest(0, least(2, trunc(value))) AS INTEGER) AS capped FROM events""",
)
def bucket_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        scalars.bucket_equal_width(v).alias("width_bucket"),
        scalars.bucket_log(v).alias("log_bucket"),
        scalars.bucket_elapsed(v * 100).alias("elapsed_bucket"),
        scalars.cap_count(v).alias("capped"),
    )


@query(
    "minmax_scale_by_group",
    """SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 9) AS scaled FROM (
  SELECT event_id, value, min(value) OVER (PARTITION BY k) AS lo, max(value) OVER (PARTITION BY k) AS hi
  FROM (SELECT *, nullif(event_type, 'click') AS k FROM events))""",
)
def minmax_scale_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), "value")
    out = features.minmax_scale_by_group(rows, ["event_type"], "value", "scaled")
    return out.select("event_id", F.round("scaled", 9).alias("scaled"))
