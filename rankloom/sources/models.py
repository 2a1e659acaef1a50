"""Saving and loading trained models by configuration type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import FMClassificationModel, GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import SparkSession

from rankloom.sources.files import path_exists


def _load_ranker(path: str):
    from rankloom.operators.ranker import PairwiseRanker

    return PairwiseRanker.load(path)


# model types of the job configuration
LOADERS: dict[str, Callable] = {
    "xgb": GBTClassificationModel.load,
    "lgb": GBTClassificationModel.load,
    "lgb_ranker": _load_ranker,
    "lr": LogisticRegressionModel.load,
    "fm": FMClassificationModel.load,
}


def load_model(kind: str, path: str):
    if kind not in LOADERS:
        raise ValueError(f"model {kind!r} not supported; one of {sorted(LOADERS)}")
    return LOADERS[kind](path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path) if hasattr(model, "write") else model.save(path)


def train_or_load(spark: SparkSession, kind: str, path: str, train: Callable, retrain: bool = False):
    """Load a saved model; train and save when there is none or ``retrain`` is set."""
    if kind not in LOADERS:
        raise ValueError(f"model {kind!r} not supported; one of {sorted(LOADERS)}")
    if retrain or not path_exists(spark, f"{path}/metadata"):
        save_model(train(), path)
    return load_model(kind, path)
