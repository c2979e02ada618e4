"""Bounded samples of labelled rows, and a logistic fit on few numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLOTS = 1 << 30


def bounded_labels(labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", where: Column | None = None) -> DataFrame:
    """(label_id, label) of at most about ``most`` labelled documents per label, chosen by a hash of the id.

    Null ids and labels are passed over; of contradictory labels of one id the smallest counts.
    """
    rows = labels.select(F.col(f"`{doc_id}`").cast("long").alias("label_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.filter(F.col("label_id").isNotNull() & F.col("label").isin(0, 1))
    rows = (rows if where is None else rows.filter(where)).groupBy("label_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    slot = F.pmod(F.xxhash64("label_id", F.lit("sample")), F.lit(_SLOTS))
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, int(_SLOTS * min(1.0, most / n))).otherwise(share)
    return rows.filter(slot < share)


def logistic(features: np.ndarray, wanted: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (features, then intercept) of a logistic regression by Newton steps; a small ridge keeps them finite."""
    x = np.c_[features, np.ones(len(features))]
    theta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (wanted - p)) - ridge * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return theta
