"""Isotonic steps and calibrated scores against the min-max formula and NumPy, over many score ranges."""

import numpy as np
import pytest

from routegauge.operators import calibration as K


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def isotonic_values(y, w):
    """max over starts of min over ends of the weighted mean of the span."""
    n, cw, cy = len(y), np.r_[0, np.cumsum(w)], np.r_[0, np.cumsum(y * w)]
    means = np.array([[(cy[k + 1] - cy[j]) / (cw[k + 1] - cw[j]) if k >= j else np.inf for k in range(n)] for j in range(n)])
    return np.array([max(means[j, i:].min() for j in range(i + 1)) for i in range(n)])


@pytest.mark.parametrize("slope", [-2.0, 0.0, 0.3, 5.0])
def test_calibration_matches_brute_force(many_ranges, slope):
    rng = np.random.default_rng(7)
    x = np.repeat(np.sort(rng.random(80)), rng.integers(1, 4, 80))
    y, w = slope * x + rng.normal(size=len(x)), rng.random(len(x)) + 0.1
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)] + [(None, 1.0, 1.0), (0.5, None, 1.0), (0.5, 9.0, 0.0)]
    df = many_ranges.createDataFrame(rows, "s double, y double, w double")
    steps = K.fit_isotonic(df, "s", "y", df["w"])
    at = np.unique(x)
    weight = np.array([w[x == a].sum() for a in at])
    want = isotonic_values(np.array([(y * w)[x == a].sum() for a in at]) / weight, weight)
    asked = np.r_[-1.0, at, (at[1:] + at[:-1]) / 2, 2.0]
    table = many_ranges.createDataFrame([(float(a),) for a in asked] + [(None,)], "s double")
    got = {r["s"]: r["calibrated"] for r in K.calibrate(steps, table, "s").collect()}
    assert got.pop(None) is None and len(got) == len(asked)
    for a in asked:
        assert got[float(a)] == pytest.approx(np.interp(a, at, want), abs=1e-9)
    assert steps.agg({"weight": "sum"}).first()[0] == pytest.approx(w.sum())


def test_calibration_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "s double, y double")
    steps = K.fit_isotonic(df, "s", "y")
    asked = spark.createDataFrame([(0.5,)], "s double")
    assert steps.count() == 0 and K.calibrate(steps, asked, "s").first()["calibrated"] is None
