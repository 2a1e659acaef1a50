"""Training-and-evaluation job: prepare, train or load, explain, score, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rankloom.checks import split_names
from rankloom.operators import training
from rankloom.operators.ranking_metrics import group_auc_report
from rankloom.sources.models import train_or_load
from rankloom.sources.readers import read_dataset, read_feature_map
from rankloom.sources.writers import predict_and_store, write_feature_scores


@dataclass
class JobPaths:
    data_root: str
    train_suffix: str | None
    test_suffix: str | None
    model: str
    predictions: str
    feature_map: str | None = None
    scores: str | None = None


def run_job(
    spark: SparkSession,
    cfg: dict,
    paths: JobPaths,
    add_category: bool = False,
    retrain: bool = False,
    explain: bool = False,
    repredict: bool = False,
) -> DataFrame:
    """(dataset, grouping, value): AUC and group AUC of the stored predictions of each dataset."""
    label = training.setting(cfg, "labelCol", "label")
    features = training.setting(cfg, "featuresCol", "features")
    datasets = {}
    for name, suffix in (("train", paths.train_suffix), ("test", paths.test_suffix)):
        raw = read_dataset(spark, paths.data_root, suffix)
        if raw is not None:
            datasets[name] = (suffix, training.prepare(raw, cfg, add_category))
    kind = cfg["model"]
    model = train_or_load(
        spark, kind, paths.model, lambda: training.train(datasets["train"][1], cfg), retrain
    )
    if explain and kind in ("xgb", "lgb"):
        names = read_feature_map(spark, paths.feature_map) if paths.feature_map else None
        categories = split_names(cfg.get("categoricalSlotNames")) if add_category else []
        for importance in ("split", "gain"):
            found = training.feature_importance(model, spark, importance, names, categories)
            write_feature_scores(found, f"{paths.scores or paths.model + '-scores'}/{importance}")
    stored = {
        name: predict_and_store(
            lambda d: training.score(model, d, features=features),
            df,
            f"{paths.predictions}/predict/{suffix}",
            features,
            repredict,
        )
        for name, (suffix, df) in datasets.items()
    }
    score_col = "prediction" if kind == "lgb_ranker" else "prob"
    return group_auc_report(stored, split_names(cfg.get("groupCols")), score_col, label)
