"""Features of requests given by ids: against NumPy, whole in a row, by blocks, and without a table every task can hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import DIM, expected

from routegauge.functions import lookups
from routegauge.operators import vector_features as E
from routegauge.operators import whole_requests as W

IDS = 40
SIZES = {1: (12, 20), 2: (1, 1), 3: (0, 4), 4: (3, 2), 5: (45, 61), 6: (5, 0), 7: (0, 0), 8: (4, 9)}


def tables(spark):
    rng = np.random.default_rng(3)
    vectors = {int(i): rng.normal(size=DIM).astype(np.float32) + 0.5 for i in rng.permutation(IDS) * 3 - 7}
    known = {i: v for i, v in vectors.items() if i % 5 != 1}  # the others have a row without a vector
    vec = spark.createDataFrame([(i, known[i].tolist() if i in known else None) for i in vectors], "vec_id bigint, vec array<float>")
    lists, truth = [], {}
    for request, sizes in SIZES.items():
        drawn = [[None if x % 7 == 3 else int(x) for x in rng.choice([*vectors, 10**12], n)] for n in sizes]
        lists.append((request, *drawn))
        truth[request] = [np.array([known[i] for i in ids if i in known], dtype=np.float64).reshape(-1, DIM) for ids in drawn]
    return spark.createDataFrame(lists, "request_id bigint, history array<bigint>, candidates array<bigint>"), vec, truth


@pytest.mark.parametrize("way", ["rows", "some by blocks", "join"])
def test_features_of_lists_match_numpy(spark, monkeypatch, way):
    lists, vec, truth = tables(spark)
    if way == "some by blocks":
        monkeypatch.setattr(E, "BLOCK", 15)
    if way == "join":
        monkeypatch.setattr(lookups, "BYTES", 100)
    got = {r["request_id"]: r.asDict() for r in E.fill_zero(lists, W.features(lists, vec, E.REC_FEATURES), E.REC_FEATURES).collect()}
    assert set(got) == set(SIZES)
    for request, (H, C) in truth.items():
        want = expected(H, C)
        for name in E.REC_FEATURES:
            assert got[request][name] == pytest.approx(want.get(name, 0.0), abs=1e-6), (request, name)


def test_only_numbers_leave_the_task_that_looks_vectors_up(spark):
    """Before, every entry's vector went through shuffles and to disk; now no exchange or file holds a vector."""
    lists, vec, _ = tables(spark)
    plan = W.features(lists, vec, E.REC_FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Scan parquet" not in plan


def test_repeated_ids_are_left_to_the_join(spark):
    _, vec, _ = tables(spark)
    assert lookups.shared(vec) is not None
    assert lookups.shared(vec.unionByName(vec)) is None
    assert lookups.shared(vec.withColumn("vec", F.slice("vec", 1, 2 + F.col("vec_id").cast("int") % 2))) is None


def test_distances_inside_clusters_at_once_equal_those_row_by_row(monkeypatch):
    import pyarrow as pa
    from routegauge.functions import matrices as M

    rng = np.random.default_rng(5)
    sides = [[rng.normal(size=(n, DIM)) for n in (7, 20, 3)] for _ in range(2)]
    labels = [[rng.integers(0, 3, len(x)).tolist() for x in side] for side in sides]
    column = lambda side: pa.array([list(x) for x in side], pa.list_(pa.list_(pa.float64())))
    got = []
    for small in (0, 1 << 10):
        monkeypatch.setattr(M, "SMALL", small)
        found = M.label_distances.func(column(sides[0]), pa.array(labels[0]), column(sides[1]), pa.array(labels[1]), pa.array([True, False, True]))
        got.append(np.array(found.to_pylist()))
    assert np.allclose(*got) and (got[0] > 0).any()
