"""Fits by tasks that hold their rows: the trees of the scans, in a few jobs."""

import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from routegauge.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(11)
    n = 900
    x = np.c_[rng.normal(size=n), rng.integers(0, 6, n), rng.random(n).round(1)]
    gain = np.clip(np.round(x[:, 0] - 0.2 * x[:, 1] + 0.5 * rng.normal(size=n)), 0, 3)
    rows = [(i, *map(float, r), float(y), 0.5 + i % 3) for i, (r, y) in enumerate(zip(x, gain, strict=True))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, gain double, weight double").repartition(5, "id").cache()


def fitted(table, monkeypatch, held, **changed):
    fold = F.col("id") % 4
    parts = [F.when(fold == k, 0).when(F.col("id") % 7 == 0, B.VALID).otherwise(B.TRAIN) for k in (0, 1, 9)]
    settings = B.Settings(**({"rounds": 9, "patience": 3, "depth": 4, "rate": 0.3, "least_rows": 12, "bins": 32} | changed))
    monkeypatch.setattr(B, "HELD_BYTES", B.HELD_BYTES if held else 0)
    cuts = B.quantile_cuts(table, FEATURES, settings.bins)
    booster = B.Booster(table, FEATURES, "gain", "weight" if changed.get("direction") else None, parts, settings, cuts)
    sc = table.sparkSession.sparkContext
    sc.setJobGroup(f"fit-{held}-{changed}", "")
    models = booster.fit()
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"fit-{held}-{changed}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return [[(t.feature.tolist(), t.border.tolist(), t.value.tolist()) for t in m.trees] for m in models], jobs


@pytest.mark.parametrize("changed", [
    {}, {"best_round": False, "patience": 50}, {"direction": {"b": -1}}, {"objective": "ndcg"}, {"objective": "ndcg", "direction": {"a": 1, "c": -1}, "l2": 0.1},
])
def test_held_rows_give_the_trees_of_the_scans_in_a_few_jobs(table, monkeypatch, changed):
    monkeypatch.setattr(B, "PART_ROWS", 200)
    monkeypatch.setattr(B, "STORE_EVERY", 4)
    held, jobs = fitted(table, monkeypatch, True, **changed)
    scanned, many = fitted(table, monkeypatch, False, **changed)
    assert held == scanned and all(held)
    assert jobs == 3 < many  # one for every model


def test_tables_beyond_the_bound_are_scanned(table):
    booster = B.Booster(table, FEATURES, "gain", None, [F.lit(B.TRAIN), F.when(F.col("id") < 90, B.TRAIN).otherwise(0)], B.Settings(rounds=1))
    assert booster.held() and booster.rows == 900
    booster.rows = B.HELD_BYTES // (len(FEATURES) + B.HELD_ROW) + 1
    assert not booster.held()


def test_rows_that_no_model_sees_are_not_kept(table):
    booster = B.Booster(table, FEATURES, "gain", None, [F.when(F.col("id") < 90, B.TRAIN).otherwise(0)], B.Settings(rounds=1))
    assert booster.rows == 90


def test_models_are_fitted_by_tasks_of_their_own(table, tmp_path):
    """All tasks wait for one another, so fits one after the other would not end."""
    from routegauge.operators import held_rows

    class Waiting(B.Settings):
        def __getattribute__(self, name):
            if name == "rounds" and TaskContext.get() is not None:
                (tmp_path / f"{TaskContext.get().taskAttemptId()}").touch()
                end = time.time() + 60
                while len(list(tmp_path.iterdir())) < 3:
                    if time.time() > end:
                        raise TimeoutError
                    time.sleep(0.05)
            return super().__getattribute__(name)

    parts = [F.when(F.col("id") % 4 == k, 0).otherwise(B.TRAIN) for k in range(3)]
    booster = B.Booster(table, FEATURES, "gain", None, parts, B.Settings(rounds=2))
    booster.settings = Waiting(rounds=2)
    assert [len(f.trees) for f in held_rows.fit_held(booster)] == [2, 2, 2]
