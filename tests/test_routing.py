"""Ranks, quantiles, sweeps, budgets and the choice of points against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.operators import labels as L
from routegauge.operators import policies as P
from routegauge.operators.ranking import quantiles, with_rank


def table(spark, n=300, seed=1, ties=20):
    rnd = random.Random(seed)
    rows = [
        (i, rnd.randint(-ties, ties) / ties, round(rnd.random(), 3), round(rnd.random(), 3), float(rnd.randint(10, 60)), float(rnd.randint(5, 900)))
        for i in range(n)
    ]
    schema = "request_id bigint, score double, mu_d double, mu_c double, tok_d double, tok_c double"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def test_rank_and_running_sum_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 30}", float(i * 7919 % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double").repartition(7)
    got = {
        r["id"]: (r["rn"], r["n"], r["run"])
        for r in with_rank(df, [F.desc("v"), F.asc("id")], by=("g",), sums={"run": "v"}).collect()
    }
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for members in groups.values():
        total = 0.0
        for place, (i, _, v) in enumerate(sorted(members, key=lambda r: (-r[2], r[0])), 1):
            total += v
            assert got[i] == (place, len(members), pytest.approx(total))


def test_quantiles_match_numpy(spark):
    values = [float(x * x % 97) for x in range(101)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v double")
    row = quantiles(df, "v", "id", {"a": 0.0, "b": 0.37, "c": 0.8, "d": 1.0}).first()
    assert [row[c] for c in "abcd"] == pytest.approx(list(np.quantile(values, [0.0, 0.37, 0.8, 1.0])))


def brute_curve(rows, rates):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    out = []
    for r in rates:
        k = round(r * len(rows))
        ndcg = [x[3] if i < k else x[2] for i, x in enumerate(order)]
        tok = [x[5] if i < k else x[4] for i, x in enumerate(order)]
        out.append((k, np.mean(ndcg), np.mean(tok)))
    return out


@pytest.mark.parametrize("n", [1, 7, 50, 300])
def test_rate_curve_equals_the_direct_sum(spark, n):
    rows, df = table(spark, n)
    grid = P.RateGrid()
    got = P.rate_curve(with_rank(df, P.by_score()), grid).orderBy("point").collect()
    want = brute_curve(rows, [i * 0.01 for i in range(101)])
    for g, (k, ndcg, tok) in zip(got, want):
        assert (g["k"], g["mean_ndcg"], g["mean_tokens"]) == (k, pytest.approx(ndcg), pytest.approx(tok))


def test_refined_grid_that_starts_above_zero(spark):
    rows, df = table(spark, 200)
    grid = P.RateGrid.around(0.6)
    got = P.rate_curve(with_rank(df, P.by_score()), grid).orderBy("point").collect()
    want = brute_curve(rows, np.arange(0.55, 0.65 + 1e-12, 0.002))
    assert len(got) == len(want)
    assert [g["mean_ndcg"] for g in got] == pytest.approx([w[1] for w in want])


def brute_greedy(rows, target):
    n, base = len(rows), sum(r[4] for r in rows)
    free = [r for r in rows if r[5] - r[4] <= 0 and r[1] > 0]
    total, chosen = base + sum(r[5] - r[4] for r in free), {r[0] for r in free}
    paid = sorted((r for r in rows if r[5] > r[4] and r[1] > 0), key=lambda r: (-(r[1] / (r[5] - r[4])), r[0]))
    for r in paid:
        if total + (r[5] - r[4]) <= target * n + 1e-9:
            total += r[5] - r[4]
            chosen.add(r[0])
    return len(chosen), total, sum(r[3] if r[0] in chosen else r[2] for r in rows) / n


def test_greedy_skips_and_goes_on(spark):
    rows, df = table(spark, 300, seed=5)
    low, high = np.mean([r[4] for r in rows]), np.mean([r[5] for r in rows])
    targets = [float(t) for t in np.linspace(low, high, 6)] + [1.0]
    for t, got in zip(targets, P.greedy_under_budgets(df, targets)):
        count, total, ndcg = brute_greedy(rows, t)
        assert (got["selected"], got["total_tokens"], got["mean_ndcg"]) == (count, pytest.approx(total), pytest.approx(ndcg))


def test_greedy_needs_few_rounds(spark, monkeypatch):
    """Tiny items alternate with ones that have just become too large; the prefix that fits is one pair long each time."""
    rows, room = [], 5000.0
    for k in range(5000):
        for delta in (0.5, room - 0.5 * k - 0.25):
            rows.append((len(rows), delta * (20_000 - len(rows)), 0.0, 0.5, 10.0, 10.0 + delta))
    columns = "request_id bigint, score double, mu_d double, mu_c double, tok_d double, tok_c double"
    df = spark.createDataFrame(rows, columns).repartition(5)
    rounds, plain = [], P._part_events
    monkeypatch.setattr(P, "_part_events", lambda *a: rounds.append(1) or plain(*a))
    targets = [10 + room / len(rows), 10 + 3 * room / len(rows), 10.01]
    for t, got in zip(targets, P.greedy_under_budgets(df, targets)):
        count, total, ndcg = brute_greedy(rows, t)
        assert (got["selected"], got["total_tokens"], got["mean_ndcg"]) == (count, pytest.approx(total), pytest.approx(ndcg))
    assert len(rounds) <= 20


def test_eta_stops_at_the_first_misfit(spark):
    rows = [(1, 1.0, 0.0, 1.0, 0.0, 10.0), (2, 0.9, 0.0, 1.0, 0.0, 100.0), (3, 0.01, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "request_id bigint, score double, mu_d double, mu_c double, tok_d double, tok_c double")
    # density 0.1, 0.009, 0.01: the third fits next, the second does not
    assert P.eta_for_budget(df, 12 / 3).first()["eta"] == pytest.approx(0.01)
    assert P.eta_for_budget(df, 0.0).first()["eta"] == math.inf
    assert P.greedy_under_budgets(df, [12 / 3])[0]["selected"] == 2


def test_threshold_at_rate_zero_still_takes_the_maximum(spark):
    rows, df = table(spark, 40)
    tau = P.tau_for_rate(with_rank(df, P.by_score()), 0.0).first()["tau"]
    assert tau == max(r[1] for r in rows)


def test_half_even_cut(spark):
    row = spark.range(1).select(*[P.rate_cut(F.lit(n), 0.5).alias(f"k{n}") for n in (1, 3, 5)]).first()
    assert (row["k1"], row["k3"], row["k5"]) == (0, 2, 2)


def curve(spark, points):
    return spark.createDataFrame(
        [(i, i / 10, float(t), float(q)) for i, (t, q) in enumerate(points)], "point bigint, rate double, mean_tokens double, mean_ndcg double"
    )


def test_front_knee_utopia_epsilon(spark):
    front = P.pareto_front(curve(spark, [(10, 0.2), (20, 0.1), (30, 0.5), (40, 0.5), (50, 0.6)]))
    kept = front.orderBy("idx").collect()
    assert [r["mean_tokens"] for r in kept] == [10, 30, 50]
    assert P.select_knee(front).first()["idx"] == 0  # both ends tie, the first wins
    assert P.select_utopia(front).first()["mean_tokens"] == 30
    assert P.select_epsilon(front, 0.5).first()["mean_tokens"] == 30
    assert P.select_epsilon(front, 0.7).first() is None


def test_symmetric_policy_inverts_for_direct(spark):
    rows, df = table(spark, 10)
    ranked = with_rank(df.withColumn("signed", -F.col("score")), P.by_score("signed"))
    policy = {"name": "budget_topr_point", "rate": 0.3, "positive_mode": "direct"}
    assert ranked.agg(F.sum(P.apply_symmetric(policy))).first()[0] == 7
    assert ranked.agg(F.sum(P.apply_symmetric({"name": "other"}))).first()[0] == 0


def test_unknown_policy_is_an_error():
    with pytest.raises(ValueError):
        P.apply_policy(None, {"name": "other"})


def test_thresholds_need_fifty_positives(spark):
    few = spark.createDataFrame([(i, 0.1 * (i + 1)) for i in range(49)], "request_id bigint, advantage double")
    row = L.rank_thresholds(few).first()
    assert row["thresholds"] == [] and row["gains"] == [0.0, 1.0]
    many = spark.createDataFrame([(i, 0.1 * (i + 1)) for i in range(60)], "request_id bigint, advantage double")
    row = L.rank_thresholds(many).first()
    assert row["thresholds"] == pytest.approx(list(np.quantile([0.1 * (i + 1) for i in range(60)], [0.5, 0.8, 0.95])))
    assert row["gains"] == [0.0, 1.0, 2.0, 4.0, 8.0]


def test_trimmed_mean(spark):
    row = spark.createDataFrame([([5.0, 1.0, 2.0, 3.0, 100.0],)], "r array<double>").select(
        L.trimmed_mean(F.col("r")).alias("plain"), L.trimmed_mean(F.col("r"), 0.2).alias("cut")
    ).first()
    assert row["plain"] == pytest.approx(22.2) and row["cut"] == pytest.approx(10 / 3)


def test_split_keeps_test_rows_and_divides_train(spark):
    df = spark.range(101).select(F.col("id").alias("request_id"), F.when(F.col("id") < 90, "train").otherwise("test").alias("split"))
    counts = {r["split"]: r["count"] for r in L.split_train_dev(df).groupBy("split").count().collect()}
    assert counts == {"train": round(90 * 0.75), "dev": 90 - round(90 * 0.75), "test": 11}


def test_selected_features_fall_back_to_all(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "request_id bigint, a double, b double, delta_tokens_mean double")
    assert L.select_features(df, ["b", "zzz"], ["a", "b"]).columns == ["request_id", "b", "delta_tokens_mean"]
    assert L.select_features(df, ["zzz"], ["a", "b"]).columns == ["request_id", "a", "b", "delta_tokens_mean"]
