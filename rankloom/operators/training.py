"""Training, scoring, grid search and explanation of tabular models on Spark ML.

Configurations use the job's key names.  What Spark's learners cannot honour
raises if it would change the result much, and is logged if it is a limit that
rarely binds (see ``reported``).
"""

from __future__ import annotations

import itertools
import json
import logging
import math
import re
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.checks import is_unset, split_names
from rankloom.functions.vectors import densify, positive_probability, to_ml_vector
from rankloom.operators.factorization import fit_blocks
from rankloom.operators.joins import name_slots
from rankloom.operators.ranker import train_pairwise_ranker
from rankloom.operators.ranking_metrics import auc, scale_pos_weight
from rankloom.operators.samples import hash_fraction, merge_category_features, repartition_for_training
from rankloom.operators.sizing import ROW_OVERHEAD

# Keys understood by every trainer.
COMMON_KEYS = {
    "model", "featuresCol", "labelCol", "weightCol", "workers", "seed", "groupCols", "categoricalSlotNames",
}
# Accepted because they only steer the original cluster runtime or its log output.
RUNTIME_KEYS = {"barrierMode", "trainingMetric", "metric", "verbosity", "treeMethod"}
GBT_KEYS = {
    "maxDepth": "maxDepth",
    "iterations": "maxIter",
    "learningRate": "stepSize",
    "baggingFraction": "subsamplingRate",
    "maxBin": "maxBins",
    "minDataInLeaf": "minInstancesPerNode",
    "minInfoGain": "minInfoGain",
    "seed": "seed",
}
# Penalties without a counterpart: only the neutral value is accepted.
NEUTRAL = {"lambda1": 0, "lambda2": 0, "alpha": 0, "lambda": 0, "gamma": 0}
# Limits without a counterpart: logged up to the value given, refused beyond it.
RARELY_BINDING = {"minSumHessionInLeaf": 1e-2, "minChildWeight": 1}
# Keys of a tree configuration that a linear ranker has no use for.
RANKER_IGNORES = {
    "maxDepth", "leaves", "featureFraction", "baggingFraction", "baggingFreq", "maxBin", "minDataInLeaf", "minSumHessionInLeaf",
    "boostingType", "isUnbalance", "lambda1", "lambda2",
}
DEFAULT_LEAVES = 31
#: share of the rows that early stopping watches when no ratio is set
WATCHED = 0.1

log = logging.getLogger(__name__)


def reported(kind: str, message: str) -> None:
    log.warning("%s: %s", kind, message)


def tree_depth(depth: int | None, leaves: int | None) -> int:
    """Depth for level-wise trees.

    A depth below 1 means no limit; then, and where the leaf limit is the
    tighter one, the depth is the least that holds the wanted leaves.
    """
    wanted = DEFAULT_LEAVES if leaves is None else leaves
    by_leaves = max(1, math.ceil(math.log2(max(2, wanted))))
    if depth is None or depth < 1:
        return by_leaves
    return depth if leaves is None else min(depth, by_leaves)


def setting(cfg: dict, key: str, default=None):
    value = cfg.get(key)
    return default if is_unset(value) else value


def check_keys(cfg: dict, allowed: set[str]) -> None:
    unknown = sorted(k for k in cfg if k not in allowed and not is_unset(cfg[k]))
    if unknown:
        raise ValueError(f"unsupported settings: {unknown}")


def mark_categorical(df: DataFrame, features: str, cardinalities: dict[int, int], width: int) -> DataFrame:
    """Declare vector slots as categorical (values 0..n-1) in the column metadata."""
    nominal = [{"idx": i, "name": f"slot_{i}", "num_vals": n} for i, n in sorted(cardinalities.items())]
    numeric = [{"idx": i, "name": f"slot_{i}"} for i in range(width) if i not in cardinalities]
    attributes = {"num_attrs": width, "attrs": {"nominal": nominal, "numeric": numeric}}
    return df.withMetadata(features, {"ml_attr": attributes})


def categorical_sizes(df: DataFrame, features: str) -> dict[int, int]:
    """Number of values of each slot that the column metadata declares as categorical."""
    attributes = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return {a["idx"]: a["num_vals"] for a in attributes if "num_vals" in a}


def mark_category_slots(df: DataFrame, features: str, names: Sequence[str]) -> DataFrame:
    """Declare the leading slots, one for each of ``names``, as categorical.

    Sizes come from one aggregation over the category columns.  Columns with
    fractions or values below 0 (an unseen value is -1) stay ordered and are
    reported.
    """
    value = {n: F.col(n).cast("double") for n in names}
    checks = [F.max(value[n]).alias(f"m{i}") for i, n in enumerate(names)]
    checks += [F.min((value[n] >= 0) & (value[n] == F.floor(value[n]))).alias(f"w{i}") for i, n in enumerate(names)]
    found = df.agg(*checks, F.first(vector_to_array(F.col(features))).alias("v")).first()
    sizes = {i: int(found[f"m{i}"]) + 1 for i in range(len(names)) if found[f"w{i}"]}
    for i, n in enumerate(names):
        if i not in sizes:
            reported("categories", f"{n} is not made of indices and stays ordered")
    return mark_categorical(df, features, sizes, len(found["v"])) if found["v"] else df


def weighted(df: DataFrame, cfg: dict, label: str) -> tuple[DataFrame, str | None]:
    """Apply the row weight and the positive-class weight of the configuration."""
    weight = setting(cfg, "weightCol")
    ratio = float(setting(cfg, "autoScalePosRatio", 0))
    explicit = float(setting(cfg, "scalePosWeight", -1.0))
    if setting(cfg, "isUnbalance", False):
        ratio = ratio or 1
    if ratio < 1 and explicit <= 1.0:
        return df, weight
    factor = float(scale_pos_weight(df, label, ratio, explicit).first()["weight"])
    base = F.col(weight) if weight else F.lit(1.0)
    return df.withColumn("_weight", base * F.when(F.col(label) == 1, F.lit(factor)).otherwise(1.0)), "_weight"


def _feature_strategy(fraction: float) -> str:
    return "all" if fraction >= 1.0 else str(fraction)


def train_gbt(df: DataFrame, cfg: dict, validation: str | None = None):
    """Binary boosted trees for ``lgb`` and ``xgb`` configurations.

    Trees grow level by level, so ``maxDepth`` and ``leaves`` become one depth
    (``tree_depth``).  Penalties raise when set; small limits on the Hessian are
    logged.  A bagging frequency of 0 turns bagging off.  Early stopping and
    ``trainTestRatio`` hold back rows by a hash; ``validation`` names a boolean
    column to use instead.  Slots marked as categorical (``prepare``) are split
    as categories, and the number of bins is raised to hold their values.
    """
    check_keys(
        cfg,
        COMMON_KEYS | RUNTIME_KEYS | set(GBT_KEYS) | set(NEUTRAL) | set(RARELY_BINDING)
        | {"objective", "boostingType", "leaves", "featureFraction", "baggingFreq", "isUnbalance", "autoScalePosRatio",
           "scalePosWeight", "trainTestRatio", "earlyStoppingRounds"},
    )
    for key, neutral in NEUTRAL.items():
        if float(setting(cfg, key, neutral)) != neutral:
            raise ValueError(f"{key} is not supported by the boosted tree learner")
    for key, most in RARELY_BINDING.items():
        value = float(setting(cfg, key, 0))
        if value > most:
            raise ValueError(f"{key} above {most} is not supported by the boosted tree learner")
        if value:
            reported(cfg.get("model", "lgb"), f"{key}={value} is not applied")
    if setting(cfg, "objective", "binary") not in ("binary", "binary:logistic"):
        raise ValueError("only the binary objective is supported")
    if setting(cfg, "boostingType", "gbdt") != "gbdt":
        raise ValueError("only gbdt boosting is supported")
    depth, leaves = setting(cfg, "maxDepth"), setting(cfg, "leaves")
    cfg = {**cfg, "maxDepth": tree_depth(None if depth is None else int(depth), None if leaves is None else int(leaves))}
    if not is_unset(cfg.get("baggingFreq")) and int(cfg["baggingFreq"]) == 0:
        cfg["baggingFraction"] = 1.0
    features, label = setting(cfg, "featuresCol", "features"), setting(cfg, "labelCol", "label")
    rows, weight = weighted(df, cfg, label)
    params = {target: cfg[key] for key, target in GBT_KEYS.items() if not is_unset(cfg.get(key))}
    for name in ("maxDepth", "maxIter", "maxBins", "minInstancesPerNode", "seed"):
        if name in params:
            params[name] = int(params[name])
    most_values = max([0, *categorical_sizes(df, features).values()])
    if most_values > int(params.get("maxBins", 32)):
        params["maxBins"] = most_values
    learner = GBTClassifier(
        featuresCol=features,
        labelCol=label,
        featureSubsetStrategy=_feature_strategy(float(setting(cfg, "featureFraction", 1.0))),
        **{"seed": 11, **params},
    )
    if weight:
        learner = learner.setWeightCol(weight)
    ratio = setting(cfg, "trainTestRatio")
    if ratio is None and int(setting(cfg, "earlyStoppingRounds", 0)) > 0:
        ratio = 1 - WATCHED
    if validation is None and ratio is not None and float(ratio) < 1.0:
        keys = [c for c in df.columns if c not in (features,)]
        rows = rows.withColumn("_validation", hash_fraction(keys) >= float(ratio))
        validation = "_validation"
    if validation:
        learner = learner.setValidationIndicatorCol(validation)
    return learner.fit(rows)


def train_lr(df: DataFrame, cfg: dict):
    check_keys(cfg, COMMON_KEYS | RUNTIME_KEYS | {"iterations", "regParam", "elasticNetParam", "tol", "isUnbalance", "autoScalePosRatio", "scalePosWeight"})
    label = setting(cfg, "labelCol", "label")
    rows, weight = weighted(df, cfg, label)
    learner = LogisticRegression(
        featuresCol=setting(cfg, "featuresCol", "features"),
        labelCol=label,
        maxIter=int(setting(cfg, "iterations", 100)),
        regParam=float(setting(cfg, "regParam", 0.0)),
        elasticNetParam=float(setting(cfg, "elasticNetParam", 0.0)),
        tol=float(setting(cfg, "tol", 1e-6)),
    )
    return (learner.setWeightCol(weight) if weight else learner).fit(rows)


def train_fm(df: DataFrame, cfg: dict):
    """Linear plus second-order interaction model; all rows in every step (``fit_blocks``) unless a fraction is set."""
    check_keys(cfg, COMMON_KEYS | RUNTIME_KEYS | {"factorSize", "iterations", "learningRate", "regParam", "miniBatchFraction"})
    if not is_unset(cfg.get("weightCol")):
        raise ValueError("weightCol is not supported by the factorisation learner")
    learner = FMClassifier(
        featuresCol=setting(cfg, "featuresCol", "features"),
        labelCol=setting(cfg, "labelCol", "label"),
        factorSize=int(setting(cfg, "factorSize", 8)),
        maxIter=int(setting(cfg, "iterations", 100)),
        stepSize=float(setting(cfg, "learningRate", 0.1)),
        regParam=float(setting(cfg, "regParam", 0.0)),
        miniBatchFraction=float(setting(cfg, "miniBatchFraction", 1.0)),
        seed=int(setting(cfg, "seed", 11)),
    )
    return fit_blocks(df, learner) if learner.getMiniBatchFraction() == 1.0 else learner.fit(df)


def train_ranker(df: DataFrame, cfg: dict):
    check_keys(cfg, COMMON_KEYS | RUNTIME_KEYS | RANKER_IGNORES | {"group", "maxPosition", "iterations", "learningRate", "objective"})
    ignored = sorted(k for k in RANKER_IGNORES if not is_unset(cfg.get(k)))
    if ignored:
        reported("lgb_ranker", f"a linear ranker does not use {ignored}")
    return train_pairwise_ranker(
        df,
        group=cfg["group"],
        label=setting(cfg, "labelCol", "label"),
        features=setting(cfg, "featuresCol", "features"),
        max_position=int(setting(cfg, "maxPosition", 20)),
        iterations=int(setting(cfg, "iterations", 20)),
        step=float(setting(cfg, "learningRate", 1.0)),
    )


TRAINERS = {"xgb": train_gbt, "lgb": train_gbt, "lr": train_lr, "fm": train_fm, "lgb_ranker": train_ranker}
#: learners that store the rows in a form of their own
STORING = {"fm"}


#: estimated bytes of samples that one task holds while a model is fitted
TRAINING_SHARE = 32 << 20


def training_parts(df: DataFrame, workers: int, features: str) -> int:
    """``workers`` partitions, or more where the rows measure more than that many tasks should hold."""
    width = F.size(vector_to_array(features)) if df.schema[features].dataType.typeName() != "array" else F.size(features)
    rows, values = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    measured = rows * (ROW_OVERHEAD + 8 * len(df.columns)) + 8 * (values or 0)
    return max(workers, -(-measured // TRAINING_SHARE))


def train(df: DataFrame, cfg: dict):
    """Fit the configured model; ``workers`` spreads the rows evenly over at least as many tasks, of a bounded size,
    and keeps them cached while fitting (once: not where the learner stores them itself)."""
    kind = cfg.get("model")
    if kind not in TRAINERS:
        raise ValueError(f"model {kind!r} not supported; one of {sorted(TRAINERS)}")
    workers = setting(cfg, "workers")
    if workers is None:
        return TRAINERS[kind](df, cfg)
    parts = training_parts(df, int(workers), setting(cfg, "featuresCol", "features"))
    if kind in STORING:
        return TRAINERS[kind](df.repartition(parts), cfg)
    rows = repartition_for_training(df, parts)
    try:
        return TRAINERS[kind](rows, cfg)
    finally:
        rows.unpersist()


def prepare(df: DataFrame, cfg: dict, add_category: bool = False) -> DataFrame:
    """Dense feature vectors, with the category columns in front when asked for."""
    features = setting(cfg, "featuresCol", "features")
    rows = densify(to_ml_vector(df, features), features)
    merged = merge_category_features(rows, cfg.get("categoricalSlotNames") if add_category else None, features)
    names = split_names(cfg.get("categoricalSlotNames")) if add_category else []
    if names and cfg.get("model") in ("lgb", "xgb"):
        return mark_category_slots(merged, features, names)
    return merged


def score(model, df: DataFrame, variant: str = "named", leaf_col: str | None = None, features: str = "features") -> DataFrame:
    """Scored rows with scalar probability columns; ``leaf_col`` adds the leaf index of every tree."""
    if not hasattr(model, "getProbabilityCol"):
        return model.transform(df, features)
    if leaf_col:
        model = model.copy()
        model.setLeafCol(leaf_col)
    return positive_probability(model.transform(df), variant)


def typed(text: str):
    """A number, true, false or null as JSON writes them; anything else stays text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def parameter_grid(cfg: dict, keys: Sequence[str]) -> list[dict]:
    """Every combination of the comma separated values of ``keys``; other settings stay as they are."""
    choices = [split_names(str(cfg[k])) if not is_unset(cfg.get(k)) else [None] for k in keys]
    fixed = {k: v for k, v in cfg.items() if k not in keys}
    return [
        {**fixed, **{k: typed(v) for k, v in zip(keys, combo) if v is not None}}
        for combo in itertools.product(*choices)
    ]


def grid_search(
    train_df: DataFrame, test_df: DataFrame, cfg: dict, keys: Sequence[str], parallelism: int = 2
) -> tuple[DataFrame, object, dict]:
    """(results, best model, best settings): every combination is fitted on its own and
    judged by exact AUC on train and test; best by test AUC."""
    grid = parameter_grid(cfg, keys)
    label = setting(cfg, "labelCol", "label")
    train_df, test_df = train_df.persist(), test_df.persist()

    def run(settings: dict):
        model = train(train_df, settings)
        values = [auc(score(model, d), "prob", label).first()[0] for d in (train_df, test_df)]
        return model, values

    try:
        with ThreadPool(parallelism) as pool:
            outcomes = pool.map(run, grid)
    finally:
        train_df.unpersist()
        test_df.unpersist()
    rows = [
        (json.dumps({k: s.get(k) for k in keys}, sort_keys=True), float(v[0]), float(v[1]))
        for s, (_, v) in zip(grid, outcomes)
    ]
    results = train_df.sparkSession.createDataFrame(rows, "params string, train_auc double, test_auc double")
    best = max(range(len(grid)), key=lambda i: rows[i][2])
    return results, outcomes[best][0], grid[best]


def feature_importance(
    model, spark, kind: str = "gain", feature_map: DataFrame | None = None, categories: Sequence[str] = ()
) -> DataFrame:
    """(name, score, idx) of every slot, the most important first; an unused slot has 0.

    ``gain``: the model's own importances; ``split``: how often a slot is used
    by a tree node.  A model is a small driver object, its node text included.
    """
    if kind == "gain":
        values = {i: float(v) for i, v in enumerate(model.featureImportances.toArray())}
    elif kind == "split":
        used = re.findall(r"If \(feature (\d+) ", model.toDebugString)
        values = dict.fromkeys(range(model.numFeatures), 0.0)
        for slot in used:
            values[int(slot)] = values.get(int(slot), 0.0) + 1.0
    else:
        raise ValueError(f"unknown importance {kind!r}")
    scores = spark.createDataFrame(sorted(values.items()), "idx int, score double")
    if feature_map is None:
        feature_map = spark.createDataFrame([], "idx int, name string")
    named = name_slots(scores, feature_map, list(categories))
    return named.orderBy(F.col("score").desc(), "name")


def dump_trees(model, names: dict[int, str] | None = None) -> str:
    """Readable tree text with slot numbers replaced by names."""
    names = names or {}
    return re.sub(r"feature (\d+)", lambda m: names.get(int(m.group(1)), m.group(0)), model.toDebugString)
