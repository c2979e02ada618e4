"""Advantage models and grading models, boosted on histograms and calibrated on the scores they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.functions.hashing import h32
from routegauge.operators.boosting import TRAIN, VALID, Booster, Model, Settings, transform_by
from routegauge.operators.calibration import fit_isotonic

VALIDATION_FOLDS = 10  # one of so many hash folds stops the advantage model

ADVANTAGE = Settings(rounds=fv.ADVANTAGE_ROUNDS, patience=fv.ADVANTAGE_PATIENCE, depth=5, least_rows=20, l2=1e-4, best_round=False)
RANKER = Settings(rounds=fv.RANKER_ROUNDS, patience=fv.RANKER_PATIENCE, depth=6, least_rows=100, l2=1e-2, objective="ndcg")


def stops(seed: int = 0) -> Column:
    """Whether a row helps to decide when the advantage model stops, instead of training it."""
    return h32("request_id", F.lit(f"stop-{seed}")) % VALIDATION_FOLDS == 0


def fold_of(folds: int, seed: int = 0) -> Column:
    return (h32("request_id", F.lit(seed)) % folds).cast("int")


def squared_error(scored: DataFrame, label: str, weight: str | None) -> float:
    """The mean squared error of ``prediction``, weighted if a column is named."""
    w = F.col(weight) if weight else F.lit(1.0)
    return scored.agg(F.sum(w * (F.col("prediction") - F.col(label)) ** 2) / F.sum(w)).first()[0]


def train_advantage(
    train: DataFrame, features: Sequence[str], label: str = "advantage", weight: str | None = "weight", seed: int = 0,
    settings: Settings = ADVANTAGE,
) -> tuple[Model, float]:
    """Boosted regression of the advantage, stopped on a tenth of ``train``, and its (weighted) error on all of ``train``."""
    part = F.when(stops(seed), VALID).otherwise(TRAIN)
    (model,) = Booster(train, list(features), label, weight, [part], settings).fit()
    return model, squared_error(model.transform(train), label, weight)


def gain_of(grade: str = "grade") -> Column:
    """The gain of a grade: 0, 1, 2, 4, ..."""
    return F.when(F.col(grade) == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.col(grade) - 1.0))


def train_ranker(
    table: DataFrame, features: Sequence[str], split: str = "split", weight: str = "weight", falling: str | None = None,
    settings: Settings = RANKER,
) -> Model:
    """Boosted ranking of ``grade`` on the rows of split ``train``, as one list; the NDCG of ``dev`` decides when to stop.

    With ``falling``, one of the features, the score never rises in that column.
    """
    if falling is not None:
        settings = Settings(**{**settings.__dict__, "direction": {falling: -1}})
    part = F.when(F.col(split) == "train", TRAIN).when(F.col(split) == "dev", VALID).otherwise(0)
    (model,) = Booster(table.withColumn("_gain", gain_of()), list(features), "_gain", weight, [part], settings).fit()
    return model


def fit_isotonic_cv(
    train: DataFrame, features: Sequence[str], label: str = "advantage", folds: int = 5, seed: int = 0, settings: Settings = ADVANTAGE
) -> tuple[Model, DataFrame]:
    """The base model, and its calibration on out-of-fold predictions.

    The model of every fold and the base model grow in the same scans; the folds are predicted in one scan as well.
    """
    fold, role = fold_of(folds, seed), F.when(stops(seed), VALID).otherwise(TRAIN)
    parts = [F.when(fold != k, role).otherwise(0) for k in range(folds)]
    *of_folds, model = Booster(train, list(features), label, None, [*parts, role], settings).fit()
    held_out = transform_by(of_folds, train, fold)
    return model, fit_isotonic(held_out, "prediction", label)
