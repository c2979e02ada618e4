"""Splits of nodes picked by the tasks that add up their sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.operators import boosting as B


@pytest.mark.parametrize("objective", ["squared", "ndcg"])
def test_splits_do_not_depend_on_partitions_and_bins_stay_with_the_tasks(spark, monkeypatch, objective):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = (np.clip(np.round(x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.normal(size=600)), 0, 3)).tolist()
    rows = spark.createDataFrame([(*map(float, r), t) for r, t in zip(x, y, strict=True)], "a double, b double, y double")
    settings = B.Settings(rounds=3, depth=3, least_rows=10, bins=16, objective=objective)
    monkeypatch.setattr(B, "PART_ROWS", 100)
    levels, fetch = [], B.Booster.sums
    monkeypatch.setattr(B.Booster, "sums", lambda self, shared: levels.append(max(int(m.slots.max()) for m in shared)) or fetch(self, shared))
    pick = B.Booster.picks

    def checked(self, shared, bounds, scale):
        splits, more = pick(self, shared, bounds, scale)
        sums, _ = fetch(self, shared)
        for k, (low, high) in bounds.items():
            cells = sums[k] * np.array([scale[k[0]], scale[k[0]], 1.0])
            assert splits.get(k) == B.best_split(cells, self.settings, self.direction, low, high)
        return splits, more

    monkeypatch.setattr(B.Booster, "picks", checked)
    found = []
    for n in (1, 5):
        table = rows.repartition(n, "a").cache()
        booster = B.Booster(table, ["a", "b"], "y", None, [F.lit(B.TRAIN)], settings, [np.linspace(-2, 2, 15)] * 2)
        if n > 1:  # small files would be read by one task
            booster.blocks = booster.blocks.repartition(n, "block")
        (model,) = booster.fit()
        found.append([(t.feature.tolist(), t.border.tolist(), t.value.tolist()) for t in model.trees])
    assert len(found[0]) == 3
    assert found[0] == found[1] or objective == "ndcg"  # equal scores at the border of the leaders follow the blocks
    assert levels == ([] if objective == "squared" else [0] * len(levels))  # only the root of a ranking comes by bins
