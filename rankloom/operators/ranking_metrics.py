"""AUC family, top-K, NDCG, percentiles of scores, class weights.

All metric functions return small DataFrames; nothing is printed or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.functions.scalars import position_discount
from rankloom.operators.chunks import (
    CHUNK,
    before_chunk,
    before_in_chunk,
    exact_quantiles,
    has_heavy_values,
    flag_groups,
    hot_groups,
    number_rows,
    quantile_cuts,
    value_histogram,
    with_chunk,
    written_once,
)
from rankloom.session import shuffle_width


def rank_sum(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), cuts: Sequence[float] | None = None
) -> DataFrame:
    """Per group: positives, negatives, won pairs (a tie counts one half), rows without a score.

    AUC = wins / (pos * neg).  Equal scores share their rank, so the result does
    not depend on row order.  Arithmetic is in doubles, so large groups cannot overflow.
    Only groups too large for one task are cut into ranges; all others are one
    range each.  ``cuts`` (see ``quantile_cuts``) may be shared by several calls
    on one table.
    """
    keys = list(keys)
    require_columns(df, [score, label, *keys])
    base = df.select(*keys, F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"))
    width = shuffle_width(df.sparkSession)
    hot = hot_groups(base, keys, width) if keys else [()]
    large = F.col("_hot")
    if not hot:
        cuts = [0.0, 1.0]  # every group is ordered as a whole
    elif cuts is None:
        cuts = quantile_cuts(flag_groups(base, keys, hot).where(large), "_s", width)
    scored = F.col("_s").isNotNull()
    marks = {"_p": (F.col("_y") == 1.0) & scored, "_n": (F.col("_y") == 0.0) & scored, "_d": ~scored}
    if has_heavy_values(cuts):
        hist = value_histogram(base, keys, "_s", [F.count_if(c).cast("double").alias(n) for n, c in marks.items()], cuts)
        hist = flag_groups(hist, keys, hot).withColumn(CHUNK, F.when(large, F.col(CHUNK)).otherwise(0))
        below = F.coalesce(F.sum("_n").over(before_in_chunk(keys, "_s")), F.lit(0.0))
        placed = hist.withColumn("_w", F.col("_p") * (below + F.col("_n") / 2.0))
        wins = F.sum("_w")
    else:
        rows = with_chunk(flag_groups(base, keys, hot).withColumns({n: c.cast("double") for n, c in marks.items()}), "_s", cuts)
        # rows without a score have no range; they are only counted, wherever they are
        anywhere = -1 - F.spark_partition_id() % width
        rows = rows.withColumn(CHUNK, F.when(large, F.coalesce(F.col(CHUNK), anywhere)).when(F.col("_s").isNull(), -1).otherwise(0))
        ranked = rows.where((F.col("_p") + F.col("_n") + F.col("_d")) > 0)
        rank = F.rank().over(Window.partitionBy(*keys, CHUNK).orderBy("_s"))
        peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, CHUNK, "_s"))
        placed = ranked.withColumn("_w", F.col("_p") * (rank + (peers - 1) / F.lit(2.0)))
        # rank sum of the positives minus the ranks they take among themselves
        wins = F.sum("_w") - F.sum("_p") * (F.sum("_p") + 1.0) / 2.0
    per_chunk = placed.groupBy(*keys, CHUNK).agg(
        wins.alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_d").alias("_d")
    )
    earlier = F.coalesce(F.sum("_n").over(before_chunk(keys)), F.lit(0.0))
    return (
        per_chunk.withColumn("_w", F.col("_w") + F.col("_p") * earlier)
        .groupBy(*keys)
        .agg(
            F.sum("_p").alias("pos"),
            F.sum("_n").alias("neg"),
            F.sum("_w").alias("wins"),
            F.sum("_d").cast("bigint").alias("unscored"),
        )
    )


def _two_class() -> F.Column:
    return (F.col("pos") > 0) & (F.col("neg") > 0)


def _auc_value() -> F.Column:
    return F.when(_two_class(), F.col("wins") / (F.col("pos") * F.col("neg")))


def auc(
    df: DataFrame, score: str = "probability", label: str = "label", cuts: Sequence[float] | None = None
) -> DataFrame:
    """Exact area under ROC; NULL when only one class is present."""
    return rank_sum(df, score, label, (), cuts).select(_auc_value().alias("auc"))


def auc_by_group(
    df: DataFrame, group: str, score: str, label: str, cuts: Sequence[float] | None = None
) -> DataFrame:
    """AUC of each non-NULL group that has both classes."""
    scored = rank_sum(df.where(F.col(group).isNotNull()), score, label, [group], cuts)
    return scored.where(_two_class()).select(
        group, _auc_value().alias("auc"), (F.col("pos") + F.col("neg")).alias("rows"), "unscored"
    )


def group_auc(
    df: DataFrame,
    group: str,
    score: str = "probability",
    label: str = "label",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Row-weighted mean of per-group AUC.

    Groups with one class are left out and weights cover the kept groups only.
    Ties are averaged; rows without a score are dropped and reported.
    """
    return auc_by_group(df, group, score, label, cuts).agg(
        (F.sum(F.col("auc") * F.col("rows")) / F.sum("rows")).alias("group_auc"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("rows").cast("bigint").alias("rows_used"),
        F.sum("unscored").cast("bigint").alias("rows_unscored"),
    )


def group_auc_report(
    datasets: dict[str, DataFrame], groups: Sequence[str], score: str = "probability", label: str = "label"
) -> DataFrame:
    """(dataset, grouping, value): overall AUC plus one group AUC per grouping column."""
    parts = []
    for name, df in datasets.items():
        cuts = quantile_cuts(df, score, shuffle_width(df.sparkSession))
        values = {"all": auc(df, score, label, cuts)}
        values |= {g: group_auc(df, g, score, label, cuts).select("group_auc") for g in groups}
        for grouping, value in values.items():
            parts.append(
                value.select(
                    F.lit(name).alias("dataset"), F.lit(grouping).alias("grouping"), F.col(value.columns[0]).alias("value")
                )
            )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def batch_mean_auc(df: DataFrame, batch: str, score: str = "probability", label: str = "label") -> DataFrame:
    """Unweighted mean of per-batch AUC over the batches that have both classes."""
    return auc_by_group(df, batch, score, label).agg(
        F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).alias("batches")
    )


def compare_predictions(
    old: DataFrame, new: DataFrame, keys: Sequence[str], group: str, score: str = "probability", label: str = "label"
) -> DataFrame:
    """Champion against challenger: key coverage, AUC and group AUC of both models.

    Each side needs unique keys (see ``dedup``).
    """
    keys = list(keys)
    side = lambda df, tag: df.select(
        *keys,
        F.col(label).alias(f"{tag}_label"),
        F.col(group).alias(f"{tag}_group"),
        F.col(score).alias(f"{tag}_score"),
        F.lit(1).alias(f"in_{tag}"),
    )
    # read by every metric below, so the joined scores are stored once
    both = written_once(side(old, "old").join(side(new, "new"), keys, "full_outer"), "compare")
    coverage = both.agg(
        F.count_if(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).alias("in_both"),
        F.count_if(F.col("in_new").isNull()).alias("only_old"),
        F.count_if(F.col("in_old").isNull()).alias("only_new"),
    )
    shared = both.where(F.col("in_old").isNotNull() & F.col("in_new").isNotNull())
    parts = []
    for tag in ("old", "new"):
        columns = (f"{tag}_score", f"{tag}_label")
        cuts = quantile_cuts(shared, columns[0], shuffle_width(shared.sparkSession))
        overall = auc(shared, *columns, cuts).select(F.col("auc").alias(f"{tag}_auc"))
        grouped = group_auc(shared, f"{tag}_group", *columns, cuts)
        parts += [overall, grouped.select(F.col("group_auc").alias(f"{tag}_group_auc"))]
    # every part is exactly one row
    return coverage.select("*", *[p.scalar().alias(p.columns[0]) for p in parts])


def rank_in_group(df: DataFrame, group: str, score: str) -> DataFrame:
    """All rows with their tie-averaged ascending rank in their group.

    Rows without a score have no rank; rows without a group form one.  A group
    that fits a task is ranked by one window.  Only larger ones go through the
    (group, score) histogram, cut into ranges, and a join on (group, score).
    """
    require_columns(df, [group, score])
    base, width = df.withColumn("_s", F.col(score).cast("double")), shuffle_width(df.sparkSession)
    hot = hot_groups(base, [group], width)
    base = flag_groups(base, [group], hot)
    large = F.col("_hot") & F.col("_s").isNotNull()
    peers = F.count(F.lit(1)).over(Window.partitionBy(group, "_s"))
    order = Window.partitionBy(group).orderBy(F.col("_s").asc_nulls_last())
    small = base.where(~large).withColumn(
        "avg_rank", F.when(F.col("_s").isNotNull(), F.rank().over(order) + (peers - 1) / F.lit(2.0))
    )
    small = small.select(*df.columns, "avg_rank")
    if not hot:
        return small
    base = base.where(large)
    hist = value_histogram(base, [group], "_s", [F.count(F.lit(1)).alias("_c")])
    inside = F.coalesce(F.sum("_c").over(before_in_chunk([group], "_s")), F.lit(0))
    totals = hist.groupBy(group, CHUNK).agg(F.sum("_c").alias("_n"))
    totals = totals.select(
        F.col(group).alias("_g"), F.col(CHUNK).alias("_r"), F.coalesce(F.sum("_n").over(before_chunk([group])), F.lit(0)).alias("_start")
    )
    ranks = hist.withColumn("_inside", inside).join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col(CHUNK) == F.col("_r")))
    ranks = ranks.select("_g", F.col("_s").alias("_v"), (F.col("_start") + F.col("_inside") + (F.col("_c") + 1) / F.lit(2.0)).alias("avg_rank"))
    ranked = base.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col("_s").eqNullSafe(F.col("_v")))
    return small.unionByName(ranked.select(*df.columns, "avg_rank"))


def position_in_group(
    df: DataFrame, group: str, score: str, tie: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """One-based place of every scored row in its group, best score first.

    Rows without a group or score are left out.  A group that fits a task is
    numbered by one window; the rows of larger ones are sorted by range over
    (group, score, ties), so even a group of one score is spread if ties differ.
    """
    require_columns(df, [group, score, *tie])
    rows = df.where(F.col(group).isNotNull()).withColumn("_s", F.col(score).cast("double")).where("_s IS NOT NULL")
    order = [F.col("_s").desc(), *[F.col(t).asc() for t in tie]]
    hot = hot_groups(rows, [group], shuffle_width(df.sparkSession))
    rows = flag_groups(rows, [group], hot)
    large = F.col("_hot")
    small = rows.where(~large).withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    small = small.select(*df.columns, out)
    if not hot:
        return small
    placed = number_rows(rows.where(large), order, [group], "_idx")
    return small.unionByName(placed.select(*df.columns, (F.col("_idx") + 1).alias(out)))


def topk_metrics(
    df: DataFrame, score: str, label: str, ks: Sequence[int], tie: Sequence[str] = ()
) -> DataFrame:
    """Hits, precision, recall and F1 among the K best scored rows, all K in one pass.

    K itself is the denominator even when fewer rows exist; recall without
    any positive row is NULL.
    """
    require_columns(df, [score, label, *tie])
    is_pos = (F.col(label).cast("int") == 1).cast("int")
    positives = df.agg(F.sum(is_pos).cast("double").alias("pos"))
    order = [F.col(score).desc(), *[F.col(t).asc() for t in tie]]
    best = df.select(score, *[t for t in tie if t != score], is_pos.alias("_hit")).orderBy(*order).limit(max(ks))
    ranked = best.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    hits = ranked.agg(*[F.sum(F.when(F.col("_rn") <= k, F.col("_hit")).otherwise(0)).cast("double").alias(f"_k{k}") for k in ks])
    tp, k = F.col("tp"), F.col("k")
    return (
        hits.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_k{k}").alias("tp")) for k in ks])).alias("r"))
        .select("r.*", positives.scalar().alias("pos"))
        .select(
            "k",
            "tp",
            (tp / k).alias("precision"),
            F.when(F.col("pos") > 0, tp / F.col("pos")).alias("recall"),
            (2.0 * tp / (2.0 * tp + (k - tp) + (F.col("pos") - tp))).alias("f1"),
        )
    )


def _gain(label: str) -> F.Column:
    return F.pow(F.lit(2.0), F.col(label).cast("double")) - 1.0


def ndcg_at_k(
    df: DataFrame, label: str, score: str, k: int, group: str | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """NDCG of the K best rows, overall or per group; 0 when the ideal gain is 0.

    Both orderings keep at most K rows per group before the shuffle
    (group-limit pushdown), so a huge group does not reach one task.
    """
    require_columns(df, [label, score, *tie, *([group] if group else [])])
    ties = [F.col(t).asc() for t in tie]
    keep = list(dict.fromkeys([*([group] if group else []), label, score, *tie]))
    base = df.select(*keep)

    def best(order, name):
        if group:
            window = Window.partitionBy(group).orderBy(*order)
            top = base.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k)
        else:
            top = base.orderBy(*order).limit(k).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
        worth = _gain(label) * position_discount(F.col("_rn"))
        zero = F.lit(0.0)
        return top.select(
            *([group] if group else []),
            (worth if name == "dcg" else zero).alias("dcg"),
            (worth if name == "ideal" else zero).alias("ideal"),
        )

    both = best([F.col(score).desc(), *ties], "dcg").unionByName(best([F.col(label).desc(), *ties], "ideal"))
    total = both.groupBy(*([group] if group else [])).agg(F.sum("dcg").alias("dcg"), F.sum("ideal").alias("ideal"))
    value = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return total.select(*([group] if group else []), value.alias("ndcg"))


DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def score_deciles(df: DataFrame, column: str = "probability", exact: bool = False) -> DataFrame:
    """(p, value) for the nine deciles, without down-sampling.

    The sketch form first joins neighbouring input splits, which bounds the
    number of sketches the last task merges.
    """
    if exact:
        return exact_quantiles(df, column, DECILES)
    source = df.select(column).coalesce(shuffle_width(df.sparkSession))
    cuts = source.agg(F.percentile_approx(column, DECILES, 10_000).alias("v"))
    names = F.array(*[F.lit(p) for p in DECILES])
    return cuts.select(F.explode(F.arrays_zip(names.alias("p"), F.col("v").alias("value"))).alias("r")).select("r.*")


def describe_scores(df: DataFrame, column: str = "probability") -> DataFrame:
    c = F.col(column).cast("double")
    return df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def scale_pos_weight(
    df: DataFrame, label: str = "label", auto_ratio: float = 0, explicit: float = -1.0
) -> DataFrame:
    """Weight of the positive class (pos, neg, weight), in single precision.

    An explicit value above 1 wins; a ratio below 1 disables balancing; more
    positives than negatives gives 1.  No positives at all is an error.
    """
    counts = df.agg(
        F.count_if(F.col(label) == 1.0).alias("pos"), F.count_if(F.col(label) == 0.0).alias("neg")
    )
    if explicit > 1.0:
        return counts.select("pos", "neg", F.lit(float(explicit)).cast("float").alias("weight"))
    if auto_ratio < 1:
        return counts.select("pos", "neg", F.lit(1.0).cast("float").alias("weight"))
    ratio = (F.col("neg").cast("float") / F.col("pos").cast("float")).cast("float")
    balanced = F.when(F.col("pos") < F.col("neg"), (ratio / F.lit(float(auto_ratio))).cast("float")).otherwise(
        F.lit(1.0).cast("float")
    )
    no_positives = F.raise_error("no positive rows: the class weight is undefined").cast("float")
    return counts.select("pos", "neg", F.when(F.col("pos") == 0, no_positives).otherwise(balanced).alias("weight"))
