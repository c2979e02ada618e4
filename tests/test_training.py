"""Boosting: splits and gradients beside brute force, stopping, folds and the direction of a column."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.operators import boosting as B
from routegauge.operators import training as T

COLUMNS = "request_id bigint, a double, tokens double, advantage double, grade int, weight double, split string"
FEATURES = ["a", "tokens"]


def rows(spark, n, seed, split="train"):
    rng = np.random.default_rng(seed)
    a, tokens = rng.random(n), rng.integers(0, 40, n).astype(float)
    signal = np.sin(6 * a) - 0.04 * tokens + rng.normal(scale=0.4, size=n)
    grade = np.digitize(signal, [0.0, 0.5, 1.0])
    table = [(i + 10_000 * seed, float(x), float(t), float(s), int(g), float(0.5 + i % 3), split)
             for i, (x, t, s, g) in enumerate(zip(a, tokens, signal, grade))]
    return spark.createDataFrame(table, COLUMNS).repartition(3)


def brute_split(x, g, h, least, l2, cuts, direction):
    """(gain, feature, bin) by trying every border on the rows themselves."""
    best = None

    def leaf(rows):
        return -g[rows].sum() / (h[rows].sum() + l2)

    def merit(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + l2)

    everything = np.ones(len(g), bool)
    for f in range(x.shape[1]):
        for b, cut in enumerate(cuts[f]):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least or direction[f] * (leaf(~left) - leaf(left)) < 0:
                continue
            gain = merit(left) + merit(~left) - merit(everything)
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, b
    return best


@pytest.mark.parametrize("direction", [0, -1, 1])
def test_first_split_equals_brute_force(spark, direction):
    train = rows(spark, 200, 1)
    settings = B.Settings(rounds=1, depth=1, least_rows=15, l2=0.5, best_round=False, direction={"tokens": direction})
    cuts = B.quantile_cuts(train, FEATURES)
    (model,) = B.Booster(train, FEATURES, "advantage", "weight", [F.lit(B.TRAIN)], settings, cuts).fit()
    table = train.select("a", "tokens", "advantage", "weight").toPandas().to_numpy()
    x, y, w = table[:, :2], table[:, 2], table[:, 3]
    start = np.average(y, weights=w)
    gain, f, b = brute_split(x, w * (start - y), w, 15, 0.5, cuts, [0, direction])
    tree = model.trees[0]
    assert (tree.feature[0], tree.border[0]) == (f, b) and model.start == pytest.approx(start)
    left = x[:, f] <= cuts[f][b]
    for side, child in ((left, 1), (~left, 2)):
        assert tree.value[child] == pytest.approx((w * (y - start))[side].sum() / (w[side].sum() + 0.5))


def test_list_gradients_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    n, places = 50, 7
    score, gain, w = rng.normal(size=n).round(1), rng.choice([0.0, 1.0, 2.0, 4.0], n), rng.random(n)
    order = np.lexsort((np.arange(n), -score))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    discount = np.where(place < places, 1 / np.log2(place + 2.0), 0.0)
    top = (np.sort(gain)[::-1][:places] / np.log2(np.arange(places) + 2.0)).sum()
    g, h, total = np.zeros(n), np.zeros(n), 0.0
    for i in range(n):
        for j in range(n):
            if gain[i] > gain[j] and min(place[i], place[j]) < places:
                apart = score[i] - score[j]
                change = (gain[i] - gain[j]) * abs(discount[i] - discount[j]) / top / (0.01 + abs(apart))
                p = 1 / (1 + np.exp(apart))
                g[i] -= p * change
                g[j] += p * change
                h[i] += p * (1 - p) * change
                h[j] += p * (1 - p) * change
                total += 2 * p * change
    bins = np.arange(n, dtype=np.uint8)[:, None]
    leaders = [{"block": 3, "row": int(r), "score": score[r], "y": gain[r], "w": w[r], "bins": bins[r].tobytes()} for r in order[:places]]
    model = B._Shared(0, 0.0, [], None, None, leaders, top)
    got_g, got_h, got_total = np.zeros(n), np.zeros(n), 0.0
    for number, part in ((3, slice(0, n)), (4, slice(0, 0))):
        block = B._Block(number, bins[part], gain[part], w[part], None, None)
        own = np.arange(len(block.y))
        mine, curve, (lead_g, lead_h, some) = B._gradients(model, block, own, score[part], "ndcg")
        got_g[own] += mine
        got_h[own] += curve
        got_g[order[:places]] += lead_g
        got_h[order[:places]] += lead_h
        got_total += some
    assert got_g == pytest.approx(w * g) and got_h == pytest.approx(w * h) and got_total == pytest.approx(total)


def test_leaders_are_shared_between_blocks(spark):
    """The sums of a round do not depend on how the rows are dealt out."""
    train = rows(spark, 300, 2)
    settings = B.Settings(rounds=4, depth=3, least_rows=10, objective="ndcg", l2=0.01)
    cuts = B.quantile_cuts(train, FEATURES)
    found = []
    for parts in (1, 7):
        table = train.coalesce(1).sortWithinPartitions("request_id").repartitionByRange(parts, "request_id").sortWithinPartitions("request_id")
        (model,) = B.Booster(table.withColumn("gain", T.gain_of()), FEATURES, "gain", "weight", [F.lit(B.TRAIN)], settings, cuts).fit()
        found.append([(t.feature.tolist(), t.border.tolist()) for t in model.trees])
    assert found[0] == found[1] and len(found[0]) == 4


def test_stops_without_gain_and_goes_on_from_stored_scores(spark, monkeypatch):
    monkeypatch.setattr(B, "STORE_EVERY", 4)
    table = rows(spark, 400, 1).unionByName(rows(spark, 200, 2, "dev"))
    part = F.when(F.col("split") == "train", B.TRAIN).otherwise(B.VALID)
    settings = B.Settings(rounds=40, patience=4, depth=3, rate=0.5)
    (model,) = B.Booster(table, FEATURES, "advantage", "weight", [part], settings).fit()
    every = B.Settings(rounds=len(model.trees) + 5, patience=1000, depth=3, rate=0.5, best_round=False)
    (longer,) = B.Booster(table, FEATURES, "advantage", "weight", [part], every, model.cuts).fit()
    assert [t.value.tolist() for t in longer.trees[: len(model.trees)]] == [t.value.tolist() for t in model.trees]
    dev = table.filter("split = 'dev'").select(*FEATURES, "advantage", "weight").toPandas().to_numpy()
    errors = []
    for k in range(1, len(longer.trees) + 1):
        score = B.Model(FEATURES, longer.cuts, longer.start, 0.5, longer.trees[:k]).score([dev[:, 0], dev[:, 1]])
        errors.append(np.average((score - dev[:, 2]) ** 2, weights=dev[:, 3]))
    best = int(np.argmin(errors[: len(model.trees) + 4])) + 1
    assert len(model.trees) == best < 40


def test_folds_share_the_scans_and_equal_separate_fits(spark):
    train = rows(spark, 500, 3)
    settings = B.Settings(rounds=12, patience=3, depth=3, best_round=False)
    cuts = B.quantile_cuts(train, FEATURES)
    fold, role = T.fold_of(3), F.when(T.stops(), B.VALID).otherwise(B.TRAIN)
    parts = [F.when(fold != k, role).otherwise(0) for k in range(3)]
    together = B.Booster(train, FEATURES, "advantage", None, parts, settings, cuts).fit()
    for k, model in enumerate(together):
        (alone,) = B.Booster(train.filter(fold != k), FEATURES, "advantage", None, [role], settings, cuts).fit()
        assert [t.value.tolist() for t in model.trees] == [t.value.tolist() for t in alone.trees]
    model, steps = T.fit_isotonic_cv(train, FEATURES, folds=3, settings=settings)
    assert model.trees and steps.count() > 1


def ndcg(score, gain, k=10):
    order = np.argsort(-score, kind="stable")[:k]
    best = np.sort(gain)[::-1][:k]
    return (gain[order] / np.log2(np.arange(len(order)) + 2)).sum() / (best / np.log2(np.arange(len(best)) + 2)).sum()


def test_ranker_never_rises_in_the_falling_column_and_ranks_better_than_regression(spark):
    table = rows(spark, 1500, 3).unionByName(rows(spark, 700, 4, "dev"))
    settings = B.Settings(rounds=60, patience=20, depth=4, least_rows=30, l2=1e-2, objective="ndcg")
    ranker = T.train_ranker(table, FEATURES, falling="tokens", settings=settings)
    assert any((t.feature == 1).any() for t in ranker.trees)  # the column is in the trees
    asked = spark.createDataFrame([(x / 10, float(t)) for x in range(10) for t in range(-5, 60)] + [(0.3, None)], "a double, tokens double")
    got = {(r["a"], r["tokens"]): r["prediction"] for r in ranker.transform(asked).collect()}
    assert got.pop((0.3, None)) == got[0.3, 0.0]
    for x in range(10):
        scores = [got[x / 10, float(t)] for t in range(-5, 60)]
        assert all(p >= q - 1e-12 for p, q in zip(scores, scores[1:])) and scores[0] > scores[-1]
    held = rows(spark, 3000, 5)
    test = ranker.transform(held).select("prediction", T.gain_of().alias("gain")).toPandas().to_numpy()
    assert ndcg(test[:, 0], test[:, 1]) > 0.6 > ndcg(np.zeros(len(test)), test[:, 1])


def test_without_rows_or_gain(spark):
    train = rows(spark, 30, 1)
    settings = B.Settings(rounds=3, least_rows=20)
    (model,) = B.Booster(train, FEATURES, "advantage", None, [F.lit(B.TRAIN)], settings).fit()  # no leaf is large enough
    assert model.trees == [] and model.start == pytest.approx(np.mean([r.advantage for r in train.collect()]))
    (none,) = B.Booster(train.limit(0), FEATURES, "advantage", None, [F.lit(B.TRAIN)], settings).fit()
    assert none.trees == [] and none.transform(train).count() == 30
