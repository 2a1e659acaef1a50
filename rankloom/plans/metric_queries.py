"""Ranking metrics over lineitem read as a prediction table.

Stand-in: user = l_suppkey, item = l_partkey, label = (l_returnflag = 'R'),
score = l_discount (many ties) or l_extendedprice (few ties).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.scalars import position_discount as discount
from rankloom.operators import losses, ranking_metrics as rm, sketches
from rankloom.operators.chunks import written_once
from rankloom.operators.samples import dedup
from rankloom.plans.registry import query, table

LABEL = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def predictions(spark, sf_dir):
    """lineitem with label and probability columns; unused columns are pruned by Catalyst."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "label": (F.col("l_returnflag") == "R").cast("double"),
            "probability": F.col("l_discount"),
            "user_id": F.col("l_suppkey"),
            "goods_id": F.col("l_partkey"),
        }
    )


def auc_sql(score: str, source: str = "lineitem", label: str = LABEL) -> str:
    return f"""
WITH h AS (SELECT {score} AS s, CAST(sum({label}) AS DOUBLE) AS p, CAST(sum(1 - ({label})) AS DOUBLE) AS n
           FROM {source} GROUP BY 1),
     c AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS below FROM h)
SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c"""


def grouped_auc_cte(group: str, score: str, source: str = "lineitem", label: str = LABEL) -> str:
    return f"""
WITH h AS (SELECT {group} AS g, {score} AS s, CAST(sum({label}) AS DOUBLE) AS p, CAST(sum(1 - ({label})) AS DOUBLE) AS n
           FROM {source} WHERE {group} IS NOT NULL GROUP BY 1, 2),
     c AS (SELECT g, p, n, sum(n) OVER (PARTITION BY g ORDER BY s) - n AS below FROM h),
     a AS (SELECT g, sum(p) AS pos, sum(n) AS neg, sum(p * (below + n / 2.0)) AS wins FROM c GROUP BY g),
     k AS (SELECT g, wins / (pos * neg) AS auc, pos + neg AS cnt FROM a WHERE pos > 0 AND neg > 0)"""


@query("auc_tied_scores", auc_sql("l_discount"))
def auc_tied_scores(spark, sf_dir):
    return rm.auc(predictions(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("auc_distinct_scores", auc_sql("l_extendedprice"))
def auc_distinct_scores(spark, sf_dir):
    return rm.auc(predictions(spark, sf_dir), "l_extendedprice").select(F.round("auc", 6).alias("auc"))


@query(
    "group_auc",
    grouped_auc_cte("l_suppkey", "l_discount")
    + """
SELECT round(sum(auc * cnt) / sum(cnt), 6) AS group_auc, count(*) AS groups,
       CAST(sum(cnt) AS BIGINT) AS rows_used FROM k""",
)
def group_auc(spark, sf_dir):
    return rm.group_auc(predictions(spark, sf_dir), "user_id").select(
        F.round("group_auc", 6).alias("group_auc"), "groups", "rows_used"
    )


@query(
    "group_auc_one_class_groups",
    grouped_auc_cte("source", "n_chars", "(SELECT d.source, d.n_chars, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id)", "quality")
    + """
SELECT round(sum(auc * cnt) / sum(cnt), 6) AS group_auc, count(*) AS groups,
       CAST(sum(cnt) AS BIGINT) AS rows_used FROM k""",
)
def group_auc_one_class_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    return rm.group_auc(rows, "source", "n_chars", "quality").select(
        F.round("group_auc", 6).alias("group_auc"), "groups", "rows_used"
    )


@query(
    "auc_by_group",
    grouped_auc_cte("l_suppkey", "l_extendedprice")
    + "\nSELECT g AS user_id, round(auc, 6) AS auc, CAST(cnt AS BIGINT) AS n_rows FROM k",
)
def auc_by_group(spark, sf_dir):
    return rm.auc_by_group(predictions(spark, sf_dir), "user_id", "l_extendedprice", "label").select(
        "user_id", F.round("auc", 6).alias("auc"), F.col("rows").cast("bigint").alias("n_rows")
    )


_TRAIN = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')"
_TEST = "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')"


def _report_part(dataset: str, grouping: str, source: str) -> str:
    if grouping == "all":
        return f"SELECT '{dataset}' AS dataset, 'all' AS grouping, auc AS value FROM ({auc_sql('l_discount', source)})"
    column = {"user_id": "l_suppkey", "line": "l_linenumber"}[grouping]
    return f"""SELECT '{dataset}' AS dataset, '{grouping}' AS grouping, value FROM (
{grouped_auc_cte(column, 'l_discount', source)} SELECT round(sum(auc * cnt) / sum(cnt), 6) AS value FROM k)"""


@query(
    "group_auc_report",
    "\nUNION ALL\n".join(
        _report_part(d, g, s) for d, s in (("train", _TRAIN), ("test", _TEST)) for g in ("all", "user_id", "line")
    ),
)
def group_auc_report(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("line", F.col("l_linenumber"))
    boundary = F.lit("1997-01-01").cast("timestamp_ntz")
    report = rm.group_auc_report(
        {
            "train": rows.where(F.col("l_shipdate") < boundary),
            "test": rows.where(F.col("l_shipdate") >= boundary),
        },
        ["user_id", "line"],
    )
    return report.withColumn("value", F.round("value", 6))


@query(
    "batch_mean_auc",
    grouped_auc_cte("(l_orderkey % 50)", "l_extendedprice")
    + "\nSELECT round(avg(auc), 6) AS mean_auc, count(*) AS batches FROM k",
)
def batch_mean_auc(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("batch", F.col("l_orderkey") % 50)
    return rm.batch_mean_auc(rows, "batch", "l_extendedprice").select(
        F.round("mean_auc", 6).alias("mean_auc"), "batches"
    )


_UNIQUE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_shipdate) AS rn FROM lineitem) WHERE rn = 1)"""


@query(
    "compare_predictions",
    f"""
WITH u AS {_UNIQUE},
     o AS (SELECT l_orderkey, l_linenumber FROM u WHERE l_shipdate < TIMESTAMP '1998-01-01'),
     n AS (SELECT l_orderkey, l_linenumber FROM u WHERE l_shipdate >= TIMESTAMP '1996-01-01'),
     both_ AS (SELECT * FROM u WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_shipdate >= TIMESTAMP '1996-01-01')
SELECT (SELECT count(*) FROM both_) AS in_both,
       (SELECT count(*) FROM o) - (SELECT count(*) FROM both_) AS only_old,
       (SELECT count(*) FROM n) - (SELECT count(*) FROM both_) AS only_new,
       (SELECT auc FROM ({auc_sql('l_discount', 'both_')})) AS old_auc,
       (SELECT v FROM ({grouped_auc_cte('l_suppkey', 'l_discount', 'both_')} SELECT round(sum(auc * cnt) / sum(cnt), 6) AS v FROM k)) AS old_group_auc,
       (SELECT auc FROM ({auc_sql('l_tax', 'both_')})) AS new_auc,
       (SELECT v FROM ({grouped_auc_cte('l_suppkey', 'l_tax', 'both_')} SELECT round(sum(auc * cnt) / sum(cnt), 6) AS v FROM k)) AS new_group_auc""",
)
def compare_predictions(spark, sf_dir):
    unique = dedup(
        predictions(spark, sf_dir),
        ["l_orderkey", "l_linenumber"],
        ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_shipdate"],
    )
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    old = unique.where(F.col("l_shipdate") < day("1998-01-01"))
    new = unique.where(F.col("l_shipdate") >= day("1996-01-01")).withColumn("probability", F.col("l_tax"))
    out = rm.compare_predictions(old, new, ["l_orderkey", "l_linenumber"], "user_id")
    return out.select(
        "in_both", "only_old", "only_new", *[F.round(c, 6).alias(c) for c in ("old_auc", "old_group_auc", "new_auc", "new_group_auc")]
    )


@query(
    "rank_in_group",
    """
WITH x AS (SELECT nullif(l_suppkey, 3) AS user_id, nullif(l_discount, 0.05) AS s, l_returnflag FROM lineitem),
r AS (SELECT *, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY user_id ORDER BY s NULLS LAST)
                + (count(*) OVER (PARTITION BY user_id, s) - 1) / 2.0 END AS r FROM x)
SELECT user_id, round(sum(r), 3) AS rank_total, round(max(r), 3) AS top_rank, count(*) - count(r) AS unranked
FROM r WHERE l_returnflag = 'R' GROUP BY 1""",
)
def rank_in_group(spark, sf_dir):
    """One supplier stands for rows without a group, one discount for rows without a score."""
    rows = predictions(spark, sf_dir).select(
        F.nullif("user_id", F.lit(3)).alias("user_id"), F.nullif("probability", F.lit(0.05)).alias("probability"), "label"
    )
    ranked = rm.rank_in_group(rows, "user_id", "probability").where("label = 1")
    return ranked.groupBy("user_id").agg(
        F.round(F.sum("avg_rank"), 3).alias("rank_total"),
        F.round(F.max("avg_rank"), 3).alias("top_rank"),
        F.count_if(F.col("avg_rank").isNull()).alias("unranked"),
    )


_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_TIE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "topk_metrics",
    f"""
WITH r AS (SELECT {LABEL} AS y, row_number() OVER (ORDER BY l_extendedprice DESC, {_TIE_SQL}) AS rn FROM lineitem),
     p AS (SELECT CAST(sum(y) AS DOUBLE) AS pos FROM r),
     t AS (SELECT k, CAST(sum(CASE WHEN rn <= k THEN y ELSE 0 END) AS DOUBLE) AS tp
           FROM r, (SELECT unnest([10, 20, 40, 80]) AS k) GROUP BY k)
SELECT k, tp, round(tp / k, 6) AS precision, round(tp / pos, 6) AS recall,
       round(2 * tp / (2 * tp + (k - tp) + (pos - tp)), 6) AS f1 FROM t, p""",
)
def topk_metrics(spark, sf_dir):
    out = rm.topk_metrics(predictions(spark, sf_dir), "l_extendedprice", "label", [10, 20, 40, 80], _TIE)
    return out.select("k", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_GRADE = "CAST(floor((l_quantity - 1) / 13) AS INTEGER)"


def _graded(spark, sf_dir):
    grade = F.floor((F.col("l_quantity") - 1) / 13).cast("int")
    return table(spark, sf_dir, "lineitem").withColumn("grade", grade)


@query(
    "ndcg_overall",
    f"""
WITH b AS (SELECT {_GRADE} AS grade, row_number() OVER (ORDER BY l_extendedprice DESC, {_TIE_SQL}) AS rs,
                  row_number() OVER (ORDER BY {_GRADE} DESC, {_TIE_SQL}) AS rl FROM lineitem)
SELECT round(sum(CASE WHEN rs <= 50 THEN (pow(2, grade) - 1) / log2(rs + 1) ELSE 0 END)
           / sum(CASE WHEN rl <= 50 THEN (pow(2, grade) - 1) / log2(rl + 1) ELSE 0 END), 6) AS ndcg FROM b""",
)
def ndcg_overall(spark, sf_dir):
    out = rm.ndcg_at_k(_graded(spark, sf_dir), "grade", "l_extendedprice", 50, tie=_TIE)
    return out.select(F.round("ndcg", 6).alias("ndcg"))


@query(
    "ndcg_by_request",
    f"""
WITH b AS (SELECT l_orderkey, {_GRADE} AS grade,
     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rs,
     row_number() OVER (PARTITION BY l_orderkey ORDER BY {_GRADE} DESC, l_linenumber, l_partkey, l_suppkey) AS rl FROM lineitem),
 s AS (SELECT l_orderkey, sum(CASE WHEN rs <= 3 THEN (pow(2, grade) - 1) / log2(rs + 1) ELSE 0 END) AS dcg,
              sum(CASE WHEN rl <= 3 THEN (pow(2, grade) - 1) / log2(rl + 1) ELSE 0 END) AS ideal FROM b GROUP BY 1)
SELECT l_orderkey AS request_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s""",
)
def ndcg_by_request(spark, sf_dir):
    rows = _graded(spark, sf_dir).withColumn("request_id", F.col("l_orderkey"))
    out = rm.ndcg_at_k(rows, "grade", "l_extendedprice", 3, "request_id", ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("request_id", F.round("ndcg", 6).alias("ndcg"))


@query(
    "position_discount",
    """
SELECT l_orderkey, l_linenumber, round(max(1 / log2(rn + 1)), 6) AS discount FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem) GROUP BY 1, 2""",
)
def position_discount(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    placed = rm.position_in_group(rows, "l_orderkey", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"])
    return (
        placed.withColumn("d", discount(F.col("position")))
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.round(F.max("d"), 6).alias("discount"))
    )


@query(
    "score_deciles_exact",
    """
SELECT p, round(v, 4) AS value FROM (
  SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]::DOUBLE[]) AS p,
         unnest(quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS v FROM lineitem)""",
)
def score_deciles_exact(spark, sf_dir):
    out = rm.score_deciles(table(spark, sf_dir, "lineitem"), "l_extendedprice", exact=True)
    return out.select("p", F.round("value", 4).alias("value"))


@query("score_deciles_approx")
def score_deciles_approx(spark, sf_dir):
    return rm.score_deciles(table(spark, sf_dir, "lineitem"), "l_extendedprice")


_SKETCHED = ["l_extendedprice", "l_quantity", "l_discount"]
_SLICES = "strftime(l_shipdate, '%Y-%m') BETWEEN '1995-06' AND '2000-03'"


def stored_sketches(spark, sf_dir):
    """One row of sketches for each month and column, stored; then those of the wanted months merged."""
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    rows = table(spark, sf_dir, "lineitem").select(month, *_SKETCHED, "l_partkey")
    stored = written_once(sketches.sketch_columns(rows, ["month"], _SKETCHED, ["l_partkey"]), "sketches")
    wanted = F.col("month").between("1995-06", "2000-03")
    return sketches.merge_sketches(stored.where(wanted)), rows.where(wanted)


@query(
    "stored_sketch_deciles",
    f"""SELECT c AS "column", p, (SELECT count(*) FROM lineitem WHERE {_SLICES}) AS n, true AS within
FROM (SELECT unnest({_SKETCHED!r}) AS c), (SELECT unnest(range(1, 10)) / 10.0 AS p)""",
)
def stored_sketch_deciles(spark, sf_dir):
    """Every decile's true rank range comes within the sketch's error of the decile asked for."""
    merged, rows = stored_sketches(spark, sf_dir)
    merged = written_once(merged, "merged")
    found = sketches.sketched_quantiles(merged, [i / 10 for i in range(1, 10)])
    values = {(r["column"], r["p"]): r["value"] for r in found.collect()}  # nine numbers for each column
    pairs = [sketches.rank_between(F.col(c), F.lit(v)) for (c, _), v in values.items()]
    ranks = rows.agg(*[x.alias(f"{side}{i}") for i, pair in enumerate(pairs) for side, x in zip("lh", pair)]).first()
    within = [
        (c, p, ranks[f"l{i}"] - sketches.RANK_ERROR <= p <= ranks[f"h{i}"] + sketches.RANK_ERROR) for i, (c, p) in enumerate(values)
    ]
    checked = spark.createDataFrame(within, "column string, p double, within boolean")
    return checked.join(merged.select("column", "n"), "column").select("column", "p", "n", "within")


@query(
    "stored_sketch_distinct",
    f"SELECT unnest({[*_SKETCHED, 'l_partkey']!r}) AS \"column\", true AS within FROM (SELECT count(*) FROM lineitem)",
)
def stored_sketch_distinct(spark, sf_dir):
    """Estimated numbers of distinct values come within the sketch's error of the exact ones."""
    merged, rows = stored_sketches(spark, sf_dir)
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in [*_SKETCHED, "l_partkey"]])
    exact = exact.unpivot([], [*_SKETCHED, "l_partkey"], "column", "exact")
    both = sketches.sketched_distinct(merged).join(exact, "column")
    return both.select("column", (F.abs(F.col("distinct_values") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact") + 1).alias("within"))


@query(
    "describe_scores",
    """SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem""",
)
def describe_scores(spark, sf_dir):
    out = rm.describe_scores(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select("n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


@query(
    "scale_pos_weight",
    f"""
WITH c AS (SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag <> 'R') AS neg FROM lineitem)
SELECT pos, neg, round(CAST(CASE WHEN pos < neg THEN (CAST(neg AS FLOAT) / CAST(pos AS FLOAT)) / CAST(2 AS FLOAT) ELSE 1 END AS DOUBLE), 5) AS weight FROM c""",
)
def scale_pos_weight(spark, sf_dir):
    out = rm.scale_pos_weight(predictions(spark, sf_dir), auto_ratio=2)
    return out.select("pos", "neg", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query(
    "binary_losses",
    f"""
WITH t AS (SELECT CAST({LABEL} AS DOUBLE) AS y, l_discount AS p FROM lineitem),
 c AS (SELECT y, p, greatest(1e-7, least(1 - 1e-7, p)) AS q,
              CASE WHEN y = 1 THEN p ELSE 1 END AS p1, CASE WHEN y = 0 THEN p ELSE 0 END AS p0 FROM t)
SELECT round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS bce,
       round(-avg(0.25 * pow(1 - p1, 2) * ln(p1 + 1e-7)) - avg(0.75 * pow(p0, 2) * ln(1 - p0 + 1e-7)), 6) AS focal,
       round(1 - (2 * sum(y * p) + 1e-6) / (sum(y * y) + sum(p * p) + 1e-6), 6) AS dice FROM c""",
)
def binary_losses(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    bce, focal, dice = losses.bce_loss(rows), losses.focal_loss(rows), losses.dice_loss(rows)
    return bce.select(
        F.round("bce", 6).alias("bce"),
        F.round(focal.scalar(), 6).alias("focal"),
        F.round(dice.scalar(), 6).alias("dice"),
    )
