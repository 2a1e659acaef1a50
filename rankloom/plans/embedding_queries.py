"""Embedding, channel, mask and prediction-table operators.

Stand-ins: ``embeddings`` as activation maps (position = channel, label =
class), as class scores (first ten slots) with scores after an attack (next
ten), and as item vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import arrays
from rankloom.operators import channels, embeddings as emb, losses, masks, predictions as pred
from rankloom.operators.behaviour import behaviour_sequence
from rankloom.plans.behaviour_queries import ITEM_SQL, behaviour_log
from rankloom.plans.registry import query, table

LONG_SQL = "(SELECT vec_id, label, unnest(generate_series(0, 63)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def maps(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("image"), "label", F.posexplode("embedding").alias("channel", "value")
    )


# ------------------------------------------------------------------ lookups and pooling

_SEQ_SQL = f"""
r AS (SELECT user_id, {ITEM_SQL} AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
s AS (SELECT user_id, rn - 1 AS pos, item FROM r WHERE rn <= 30)"""


def sequences(spark, sf_dir):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return behaviour_sequence(behaviour_log(spark, sf_dir), ["user_id"], "item", 30, order, out="ids")


@query(
    "lookup_embeddings",
    f"""
WITH {_SEQ_SQL},
u AS (SELECT DISTINCT user_id FROM r),
f AS (SELECT u.user_id, p.pos, coalesce(s.item, 0) AS item FROM u CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS pos) p
      LEFT JOIN s ON s.user_id = u.user_id AND s.pos = p.pos),
l AS (SELECT user_id, list(struct_pack(k := pos, e := e.embedding) ORDER BY pos) AS v FROM f LEFT JOIN embeddings e ON e.vec_id = f.item GROUP BY 1),
d AS (SELECT user_id, unnest(v).k AS pos, unnest(v).e AS e FROM l)
SELECT user_id, CAST(30 AS INTEGER) AS n, CAST(pos AS INTEGER) AS pos, CAST(i - 1 AS INTEGER) AS dim, round(CAST(e[i] AS DOUBLE), 6) AS v
FROM d, (SELECT unnest(generate_series(1, 64)) AS i) WHERE e IS NOT NULL
UNION ALL SELECT user_id, CAST(30 AS INTEGER), CAST(pos AS INTEGER), NULL, NULL FROM d WHERE e IS NULL
UNION ALL SELECT -1, 0, NULL, NULL, NULL UNION ALL SELECT -2, NULL, NULL, NULL, NULL""",
)
def lookup_embeddings(spark, sf_dir):
    """All users, and two more rows: one with an empty list, one without a list; all slots of all vectors are compared."""
    odd = spark.createDataFrame([(-1, []), (-2, None)], "user_id bigint, ids array<bigint>")
    rows = sequences(spark, sf_dir).unionByName(odd)
    out = emb.lookup_embeddings(rows, ["user_id"], "ids", vectors(spark, sf_dir), "vec_id", "embedding")
    rows = out.select("user_id", F.when(F.col("vectors").isNotNull(), F.size("vectors")).alias("n"), F.posexplode_outer("vectors").alias("pos", "vec"))
    return rows.select("user_id", "n", "pos", F.posexplode_outer("vec").alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query(
    "sum_pool_sequence",
    f"""
WITH {_SEQ_SQL},
x AS (SELECT s.user_id, unnest(generate_series(0, 63)) AS dim, CAST(unnest(e.embedding) AS DOUBLE) AS v FROM s JOIN embeddings e ON e.vec_id = s.item
      WHERE s.item > 0)
SELECT u.user_id, CAST(d.dim AS INTEGER) AS dim, round(coalesce(sum(v), 0), 6) + 0.0 AS v
FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS dim) d LEFT JOIN x ON x.user_id = u.user_id AND x.dim = d.dim
GROUP BY 1, 2
UNION ALL SELECT k, CAST(unnest(generate_series(0, 63)) AS INTEGER), 0.0 FROM (VALUES (-1), (-2), (-3)) AS o(k)""",
)
def sum_pool_sequence(spark, sf_dir):
    """All users, and three more rows: only padding and unknown ids, an empty list, no list."""
    odd = spark.createDataFrame([(-1, [0, 10**9, 0, -4]), (-2, []), (-3, None)], "user_id bigint, ids array<bigint>")
    rows = sequences(spark, sf_dir).unionByName(odd)
    out = emb.sum_pool_sequence(rows, ["user_id"], "ids", vectors(spark, sf_dir), "vec_id", "embedding")
    return out.select("user_id", F.posexplode("pooled").alias("dim", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query(
    "score_pairs",
    f"""
WITH p AS (SELECT DISTINCT user_id, {ITEM_SQL} AS item FROM events UNION ALL VALUES (-1, 3), (3, -1), (-1, -1))
SELECT p.user_id, p.item AS item_id, round(1 / (1 + exp(-list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]))), 6) AS score
FROM p LEFT JOIN embeddings u ON u.vec_id = p.user_id LEFT JOIN embeddings i ON i.vec_id = p.item""",
)
def score_pairs(spark, sf_dir):
    """All pairs, and three more with a user or an item that has no vector."""
    pairs = behaviour_log(spark, sf_dir).select("user_id", F.col("item").alias("item_id")).distinct()
    pairs = pairs.unionByName(spark.createDataFrame([(-1, 3), (3, -1), (-1, -1)], "user_id bigint, item_id bigint"))
    users = vectors(spark, sf_dir).select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vec"))
    items = vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    out = emb.score_pairs(pairs, users, items, "user_id", "item_id")
    return out.select("user_id", "item_id", F.round("score", 6).alias("score"))


@query(
    "top_items",
    """
WITH s AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id, list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
           FROM embeddings u CROSS JOIN embeddings i),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM s)
SELECT user_id, item_id, round(score, 5) AS score, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5""",
)
def top_items(spark, sf_dir):
    users = vectors(spark, sf_dir).select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vec"))
    items = vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    out = emb.top_items(users, items, 5)
    return out.withColumn("score", F.round("score", 5))


_FM_SQL = """
WITH f AS (SELECT vec_id, i % 8 AS dim, v FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(0.5 * (pow(sum(v), 2) - sum(v * v)), 6) AS fm,
       round(0.5 * (pow(sum(v), 2) - sum(v * v)) / 8, 6) AS mean_pair FROM f GROUP BY 1, 2"""


@query("fm_second_order", _FM_SQL)
def fm_second_order(spark, sf_dir):
    fields = vectors(spark, sf_dir).select("vec_id", emb.split_fields(F.col("embedding"), 8, 8).alias("f"))
    both = fields.select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                emb.fm_second_order(F.col("f"), 8).alias("fm"), emb.pairwise_interaction(F.col("f"), 8).alias("mean_pair")
            )
        ).alias("dim", "r"),
    )
    return both.select("vec_id", "dim", F.round("r.fm", 6).alias("fm"), F.round("r.mean_pair", 6).alias("mean_pair"))


@query(
    "group_covariance",
    f"""
WITH a AS {LONG_SQL}
SELECT CAST(x.channel // 16 AS INTEGER) AS grp, CAST(x.channel % 16 AS INTEGER) AS i, CAST(y.channel % 16 AS INTEGER) AS j,
  round(0.999 * covar_samp(x.v, y.v) + CASE WHEN x.channel = y.channel THEN 0.001 ELSE 0 END, 6) AS cov
FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.channel // 16 = y.channel // 16 GROUP BY x.channel, y.channel""",
)
def group_covariance(spark, sf_dir):
    return emb.group_covariance(vectors(spark, sf_dir), "embedding", 16).withColumn("cov", F.round("cov", 6))


def _whitened(kind):
    def run(spark, sf_dir):
        rows = vectors(spark, sf_dir)
        out = emb.Whitening.fit(rows, "embedding", 16, kind).transform(rows, "embedding")
        return out.select("vec_id", F.posexplode("whitened").alias("pos", "v")).withColumn("v", F.round("v", 6))

    return run


for _kind in emb.Whitening.KINDS:
    query(f"whitening_{_kind}")(_whitened(_kind))


@query(
    "whitening_identity",
    f"""
SELECT kind, CAST(grp AS INTEGER) AS grp, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS cov
FROM (SELECT unnest({list(emb.Whitening.KINDS)!r}) AS kind), range(4) g(grp), range(16) a(i), range(16) b(j) WHERE (SELECT count(*) FROM embeddings) > 16""",
)
def whitening_identity(spark, sf_dir):
    """The covariance of whitened vectors is the identity, to two places, for every kind."""
    rows = vectors(spark, sf_dir).select(F.transform("embedding", lambda v: v * 100.0).alias("x"))
    found = None
    for kind in emb.Whitening.KINDS:
        white = emb.Whitening.fit(rows, "x", 16, kind, 1e-6, 40).transform(rows, "x")
        one = emb.group_covariance(white, "whitened", 16, 0.0).select(F.lit(kind).alias("kind"), "grp", "i", "j", (F.round("cov", 2) + 0.0).alias("cov"))
        found = one if found is None else found.unionByName(one)
    return found


# ------------------------------------------------------------------ channels and masks


@query(
    "channel_thresholds",
    f"SELECT CAST(channel AS INTEGER) AS channel, round(quantile_cont(v, 0.995), 6) AS threshold FROM {LONG_SQL} GROUP BY 1",
)
def channel_thresholds(spark, sf_dir):
    return channels.channel_thresholds(maps(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6))


@query(
    "channel_class_belonging",
    f"""
WITH m AS (SELECT channel, label, sum(v) / count(DISTINCT vec_id) AS mean FROM {LONG_SQL} GROUP BY 1, 2)
SELECT CAST(channel AS INTEGER) AS channel, label AS belongs FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY mean DESC, label) AS rn FROM m) WHERE rn = 1""",
)
def channel_class_belonging(spark, sf_dir):
    return channels.channel_class_belonging(maps(spark, sf_dir))


@query(
    "topk_per_class",
    f"""
WITH m AS (SELECT channel, label, sum(v) / count(DISTINCT vec_id) AS weight FROM {LONG_SQL} GROUP BY 1, 2)
SELECT label, CAST(channel AS INTEGER) AS channel, round(weight, 6) AS weight, CAST(rn AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, channel) AS rn FROM m) WHERE rn <= 3""",
)
def topk_per_class(spark, sf_dir):
    weights = channels.channel_class_means(maps(spark, sf_dir), "image", "channel", "value", "label")
    out = channels.topk_per_class(weights.withColumnRenamed("mean", "weight"))
    return out.select("label", "channel", F.round("weight", 6).alias("weight"), "rank")


@query(
    "mask_iou",
    """
WITH p AS (SELECT vec_id, CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END AS f, CASE WHEN embedding[i + 32] > 0 THEN 1 ELSE 0 END AS p
           FROM (SELECT vec_id, embedding, unnest(generate_series(1, 32)) AS i FROM embeddings))
SELECT vec_id, round(CASE WHEN sum(f * p) = 0 THEN 0 ELSE CAST(sum(f * p) AS DOUBLE) / sum(CASE WHEN f + p > 0 THEN 1 ELSE 0 END) END, 9) AS iou FROM p GROUP BY 1""",
)
def mask_iou(spark, sf_dir):
    binary = F.transform("embedding", lambda v: (v > 0).cast("int"))
    iou = masks.mask_iou(F.slice("m", 1, 32), F.slice("m", 33, 32))
    return vectors(spark, sf_dir).select("vec_id", binary.alias("m")).select("vec_id", F.round(iou, 9).alias("iou"))


@query(
    "association_score",
    f"""
WITH m AS (SELECT vec_id, channel // 16 AS c, channel % 16 AS pos, v FROM {LONG_SQL}),
 t AS (SELECT c, quantile_cont(v, 0.7) AS t FROM m GROUP BY 1),
 a AS (SELECT m.vec_id, m.c, m.pos, CASE WHEN v - t > 0 THEN 1 ELSE 0 END AS f FROM m JOIN t ON m.c = t.c),
 k AS (SELECT vec_id, part, pos, CASE WHEN v > 0 THEN 1 ELSE 0 END AS p FROM (
        SELECT vec_id, 'front' AS part, channel AS pos, v FROM {LONG_SQL} WHERE channel < 16
        UNION ALL SELECT vec_id, 'back', 63 - channel, v FROM {LONG_SQL} WHERE channel >= 48)),
 o AS (SELECT a.vec_id, a.c, k.part, sum(f * p) AS i, sum(CASE WHEN f + p > 0 THEN 1 ELSE 0 END) AS u
       FROM a JOIN k ON a.vec_id = k.vec_id AND a.pos = k.pos GROUP BY 1, 2, 3),
 r AS (SELECT c, part, avg(CASE WHEN i > 0 AND CAST(i AS DOUBLE) / u > 0.2 THEN 1.0 ELSE 0.0 END) AS rate FROM o GROUP BY 1, 2)
SELECT CAST(c AS INTEGER) AS channel, round(max(rate), 6) AS association FROM r GROUP BY 1""",
)
def association_score(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    four = F.array(*[F.slice("embedding", 16 * c + 1, 16) for c in range(4)])
    activation = rows.select(F.col("vec_id").alias("image"), F.posexplode(four).alias("channel", "values"))
    binary = lambda c: F.transform(c, lambda v: (v > 0).cast("int"))
    parts = F.array(
        F.struct(F.lit("front").alias("part"), binary(F.slice("embedding", 1, 16)).alias("mask")),
        F.struct(F.lit("back").alias("part"), binary(F.reverse(F.slice("embedding", 49, 16))).alias("mask")),
    )
    part_masks = rows.select(F.col("vec_id").alias("image"), F.inline(parts))
    out = masks.association_score(activation, part_masks, rate=0.3)
    return out.withColumn("association", F.round("association", 6))


_FINE = ["head", "beak", "neck", "lwing", "lear", "lbleg", "rfleg", "tail"]


def _coarse_sql() -> str:
    cases = []
    for c in masks.CATEGORIES:
        for coarse, fines in masks.coarse_parts(c).items():
            for fine in fines:
                cases.append(f"('{c}', '{coarse}', '{fine}')")
    return "(VALUES " + ", ".join(cases) + ") AS m(category, coarse, part)"


@query(
    "merge_part_masks",
    f"""
WITH c AS (SELECT vec_id, ({masks.CATEGORIES!r})[label % 6 + 1] AS category, ({_FINE!r})[channel // 8 + 1] AS part, channel % 8 AS pos,
           CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM {LONG_SQL}),
 g AS (SELECT c.vec_id, c.category, m.coarse, c.pos, max(v) AS v FROM c JOIN {_coarse_sql()} ON c.category = m.category AND c.part = m.part GROUP BY 1, 2, 3, 4),
 w AS (SELECT DISTINCT c.vec_id, c.category, m.coarse, c.pos FROM c JOIN {_coarse_sql()} ON c.category = m.category)
SELECT w.vec_id AS image, w.category, w.coarse, CAST(w.pos AS INTEGER) AS pos, coalesce(g.v, 0) AS v FROM w
LEFT JOIN g ON g.vec_id = w.vec_id AND g.coarse = w.coarse AND g.pos = w.pos""",
)
def merge_part_masks(spark, sf_dir):
    categories = F.array(*[F.lit(c) for c in masks.CATEGORIES])
    fine = F.array(
        *[F.struct(F.lit(n).alias("part"), F.slice("m", 8 * i + 1, 8).alias("mask")) for i, n in enumerate(_FINE)]
    )
    rows = vectors(spark, sf_dir).select(
        F.col("vec_id").alias("image"),
        categories[F.col("label") % 6].alias("category"),
        F.transform("embedding", lambda v: (v > 0).cast("int")).alias("m"),
    )
    merged = masks.merge_part_masks(rows.select("image", "category", F.inline(fine)))
    return merged.select("image", "category", "coarse", F.posexplode("mask").alias("pos", "v"))


_BOX_SQL = """(SELECT l_orderkey AS image, l_returnflag AS category, l_linenumber * 10 AS xmin, CAST(l_suppkey AS INTEGER) AS ymin,
  CAST(l_linenumber * 10 + l_quantity - 10 AS INTEGER) AS xmax, CAST(l_suppkey + floor(l_tax * 100) AS INTEGER) AS ymax,
  CAST(60 + l_linenumber AS INTEGER) AS width, CAST(40 + l_quantity AS INTEGER) AS height, l_partkey * 100 + l_linenumber AS box_no FROM lineitem)"""


def boxes(spark, sf_dir):
    """Boxes read off lineitem; some are reversed, empty or outside the image."""
    line = F.col("l_linenumber") * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.col("l_returnflag").alias("category"),
        line.alias("xmin"),
        F.col("l_suppkey").cast("int").alias("ymin"),
        (line + F.col("l_quantity") - 10).cast("int").alias("xmax"),
        (F.col("l_suppkey") + F.floor(F.col("l_tax") * 100)).cast("int").alias("ymax"),
        (F.lit(60) + F.col("l_linenumber")).alias("width"),
        (F.lit(40) + F.col("l_quantity")).cast("int").alias("height"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("box_no"),
    )


@query(
    "normalize_boxes",
    f"""
WITH s AS (SELECT image, box_no, CAST(xmin AS DOUBLE) / width AS x0, CAST(xmax AS DOUBLE) / width AS x1, CAST(ymin AS DOUBLE) / height AS y0, CAST(ymax AS DOUBLE) / height AS y1 FROM {_BOX_SQL})
SELECT image, box_no, round(least(greatest(least(x0, x1), 0), 1), 6) AS xmin_scaled, round(least(greatest(greatest(x0, x1), 0), 1), 6) AS xmax_scaled,
       round(least(greatest(least(y0, y1), 0), 1), 6) AS ymin_scaled, round(least(greatest(greatest(y0, y1), 0), 1), 6) AS ymax_scaled FROM s""",
)
def normalize_boxes(spark, sf_dir):
    out = masks.normalize_boxes(boxes(spark, sf_dir))
    names = ("xmin_scaled", "xmax_scaled", "ymin_scaled", "ymax_scaled")
    return out.select("image", "box_no", *[F.round(c, 6).alias(c) for c in names])


@query(
    "largest_box",
    f"""
WITH a AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area FROM {_BOX_SQL})
SELECT image, category, ymin, xmin, ymax, xmax, area FROM (SELECT *, row_number() OVER (PARTITION BY image, category ORDER BY area DESC, box_no, ymin) AS rn FROM a WHERE area > 0) WHERE rn = 1""",
)
def largest_box(spark, sf_dir):
    return masks.largest_box(boxes(spark, sf_dir), order=("box_no", "ymin"))


@query(
    "single_object_images",
    f"SELECT image, category FROM {_BOX_SQL} GROUP BY 1, 2 HAVING count(*) = 1",
)
def single_object_images(spark, sf_dir):
    return masks.single_object_images(boxes(spark, sf_dir))


@query(
    "collect_labels",
    """
WITH f AS (SELECT l_linestatus AS split, l_orderkey AS image, l_returnflag AS category, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2, 3)
SELECT split, image, string_agg(category, ' ' ORDER BY p, category) AS labels FROM f GROUP BY 1, 2""",
)
def collect_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("split"),
        F.col("l_orderkey").alias("image"),
        F.col("l_returnflag").alias("category"),
        F.col("l_partkey").alias("pos"),
    )
    return masks.collect_labels(rows).withColumn("labels", F.array_join("labels", " "))


@query(
    "shape_stats",
    f"SELECT min(height) AS min_height, max(height) AS max_height, min(width) AS min_width, max(width) AS max_width FROM {_BOX_SQL}",
)
def shape_stats(spark, sf_dir):
    return masks.shape_stats(boxes(spark, sf_dir))


@query("split_counts", "SELECT l_linestatus AS split, count(*) AS n FROM lineitem GROUP BY 1")
def split_counts(spark, sf_dir):
    return masks.split_counts(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("split")))


# ------------------------------------------------------------------ prediction tables

_ARG = "(list_position({0}, list_max({0})) - 1)"
_CLEAN, _ADV = "embedding[1:10]", "embedding[11:20]"
_PRED_SQL = f"""(SELECT vec_id, label, CAST({_ARG.format(_CLEAN)} AS INTEGER) AS pc, CAST({_ARG.format(_ADV)} AS INTEGER) AS pa,
  (vec_id % 3) AS epsilon, CAST((label + 1) % 10 AS INTEGER) AS target FROM embeddings)"""


def attacked(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "vec_id",
        "label",
        F.slice("embedding", 1, 10).alias("clean"),
        F.slice("embedding", 11, 10).alias("adversarial"),
        (F.col("vec_id") % 3).alias("epsilon"),
        ((F.col("label") + 1) % 10).alias("target"),
    )


@query("keep_correct", f"SELECT vec_id, label, pa AS after_attack FROM {_PRED_SQL} WHERE pc = label")
def keep_correct(spark, sf_dir):
    kept = pred.keep_correct(attacked(spark, sf_dir))
    return kept.select("vec_id", "label", arrays.argmax(F.col("adversarial")).alias("after_attack"))


@query("keep_untargeted", f"SELECT vec_id, target FROM {_PRED_SQL} WHERE pc = label AND pc <> target")
def keep_untargeted(spark, sf_dir):
    return pred.keep_untargeted(pred.keep_correct(attacked(spark, sf_dir))).select("vec_id", "target")


@query(
    "accuracy_by_epsilon",
    f"SELECT epsilon, round(avg(CASE WHEN pa = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_PRED_SQL} GROUP BY 1",
)
def accuracy_by_epsilon(spark, sf_dir):
    out = pred.accuracy(attacked(spark, sf_dir), "adversarial", by=["epsilon"])
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "attack_success_rate",
    f"SELECT epsilon, round(1 - avg(CASE WHEN pa = label THEN 1.0 ELSE 0.0 END), 4) AS success_rate FROM {_PRED_SQL} WHERE pc = label AND pc <> target GROUP BY 1",
)
def attack_success_rate(spark, sf_dir):
    return pred.attack_success_rate(attacked(spark, sf_dir), target="target")


@query(
    "attack_target_matrix",
    f"""SELECT epsilon, label AS origin, CAST(t AS INTEGER) AS target, round(avg(CASE WHEN pa = t THEN 1.0 ELSE 0.0 END), 4) AS rate
FROM {_PRED_SQL}, (SELECT unnest(generate_series(0, 9)) AS t) WHERE pc = label GROUP BY 1, 2, 3""",
)
def attack_target_matrix(spark, sf_dir):
    return pred.attack_target_matrix(attacked(spark, sf_dir), list(range(10)))


@query(
    "margin_and_spread_loss",
    """
WITH c AS (SELECT vec_id, label, i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS s, CAST(embedding[label + 1] AS DOUBLE) AS t
           FROM (SELECT *, unnest(generate_series(1, 10)) AS i FROM embeddings)),
 r AS (SELECT vec_id, sum(CASE WHEN k = label THEN pow(greatest(0.9 - s, 0), 2) ELSE 0.5 * pow(greatest(s - 0.1, 0), 2) END) AS margin,
              sum(CASE WHEN k <> label THEN pow(greatest(0, 0.5 - (t - s)), 2) ELSE 0 END) AS spread FROM c GROUP BY 1)
SELECT round(sum(margin) / (10 * count(*)), 6) AS margin_loss, round(avg(spread), 6) AS spread_loss FROM r""",
)
def margin_and_spread_loss(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", F.slice("embedding", 1, 10).alias("scores"))
    margin = losses.margin_loss(rows, "scores", "label")
    spread = losses.spread_loss(rows, "scores", "label", 0.5)
    return margin.select(F.round("margin_loss", 6).alias("margin_loss"), F.round(spread.scalar(), 6).alias("spread_loss"))


@query(
    "distribution_entropy",
    f"""
WITH w AS (SELECT vec_id, abs(v) AS v FROM {LONG_SQL}),
 t AS (SELECT vec_id, sum(v) AS t FROM w GROUP BY 1),
 h AS (SELECT w.vec_id, sum(CASE WHEN v > 0 THEN -(v / t) * ln(v / t) ELSE 0 END) AS h FROM w JOIN t ON w.vec_id = t.vec_id GROUP BY 1)
SELECT round(avg(h), 6) AS mean_entropy, round(stddev_pop(h), 6) AS std_entropy FROM h""",
)
def distribution_entropy(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("p"))
    out = losses.distribution_entropy(rows, "p")
    return out.select(F.round("mean_entropy", 6).alias("mean_entropy"), F.round("std_entropy", 6).alias("std_entropy"))
