"""Hand cases for answer parsing and list metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.functions import answers as A
from routegauge.functions import list_metrics as LM
from routegauge.operators import ir_scores, mode_compare, rec_scores


def evaluate(spark, value, **columns):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in columns.items())
    df = spark.createDataFrame([tuple(v for _, v in columns.values())], schema)
    return df.select(value.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, ids",
    [
        ("<output>Recommendation result: [3, 1, 2]</output>", [3, 1, 2]),
        ("<OUTPUT>\n ranking  RESULT : 3，1 , 2 </OUTPUT>", [3, 1, 2]),
        ("<output>Ranking result: [none]</output> 4, 5", []),  # the first form that matches decides
        ("so Ranking result: 7, 8 and more", [7, 8]),
        ("  5 , 6,7\n", [5, 6, 7]),
        ("first [a 9\n10] then [11]", [9, 10]),
        ("no ids", []),
        ("", []),
        (None, []),
        ("007, 7", [7, 7]),
    ],
)
def test_rec_ids(spark, text, ids):
    assert evaluate(spark, A.rec_ids(F.col("t")), t=("string", text)) == ids


def test_overlong_id_keeps_its_place(spark):
    ids = evaluate(spark, A.rec_ids(F.col("t")), t=("string", "[1, 99999999999999999999999, 2]"))
    assert ids[0] == 1 and ids[1] < 0 and ids[2] == 2


def test_ir_ids_prefer_the_tag_and_drop_repeats(spark):
    assert evaluate(spark, A.ir_ids(F.col("t")), t=("string", "[z] <output>[b] > [A] > [B]</output>")) == ["B", "A"]
    assert evaluate(spark, A.ir_ids(F.col("t")), t=("string", "[c] > [D2]")) == ["C", "D2"]


def test_binary_ndcg_denominator_uses_the_shorter_list(spark):
    cols = {"p": ("array<bigint>", [5]), "t": ("array<bigint>", [5, 6, 7])}
    assert evaluate(spark, LM.binary_ndcg(F.col("p"), F.col("t"), 10), **cols) == pytest.approx(1.0)
    assert evaluate(spark, LM.recall(F.col("p"), F.col("t"), 10), **cols) == pytest.approx(1 / 3)


def test_empty_lists(spark):
    empty_pred = {"p": ("array<bigint>", []), "t": ("array<bigint>", [1])}
    empty_truth = {"p": ("array<bigint>", [1]), "t": ("array<bigint>", [])}
    assert evaluate(spark, LM.binary_ndcg(F.col("p"), F.col("t")), **empty_pred) is None
    assert evaluate(spark, LM.binary_ndcg(F.col("p"), F.col("t")), **empty_truth) == 0.0
    assert evaluate(spark, LM.recall(F.col("p"), F.col("t")), **empty_truth) == 0.0


def ir(spark, fn, pred, truth):
    return evaluate(spark, fn, p=("array<string>", pred), t=("array<string>", truth))


def test_footrule_can_be_negative(spark):
    assert ir(spark, LM.footrule(F.col("p"), F.col("t")), list("AXYZB"), list("BA")) == pytest.approx(-1.5)
    assert ir(spark, LM.footrule(F.col("p"), F.col("t")), ["A"], ["A", "B"]) == 1.0
    assert ir(spark, LM.footrule(F.col("p"), F.col("t")), ["X"], ["A", "B"]) == 0.0


def test_pairwise_needs_two_common_ids(spark):
    value = LM.pairwise_accuracy(F.col("p"), F.col("t"))
    assert ir(spark, value, ["A", "X"], ["A", "B"]) == 0.0
    assert ir(spark, value, ["A", "C", "B"], ["A", "B", "C"]) == pytest.approx(2 / 3)


def test_repeated_truth_id_counts_at_its_last_place(spark):
    # truth A B A: A has rank 2 (rel 1), B rank 1 (rel 2)
    got = ir(spark, LM.graded_ndcg(F.col("p"), F.col("t"), 2), ["A", "B"], ["A", "B", "A"])
    assert got == pytest.approx((1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)))


def test_five_run_columns_and_padding(spark):
    runs = spark.createDataFrame(
        [(1, "cot", i, None if i == 2 else 0.5 + i, 0.1 * i) for i in range(1, 8)],
        "request_id bigint, mode string, run int, ndcg10 double, ndcg5 double",
    ).withColumn("recall10", F.col("ndcg10")).withColumn("recall5", F.col("ndcg5"))
    row = rec_scores.request_metrics(runs).first()
    assert row["ndcg10_2"] == -1.0 and row["ndcg10_5"] == 5.5
    assert row["avg_ndcg@10"] == pytest.approx((1.5 + 3.5 + 4.5 + 5.5) / 4)  # first five runs, failure skipped
    assert row["avg_ndcg@5"] == pytest.approx(0.1 * sum(range(1, 8)) / 7)  # all runs


def test_run_columns_under_untidy_names():
    cols = ["index", "NDCG10 - 2".replace(" - ", "-"), "ndcg10_1", "Ndcg10 3"]
    assert mode_compare.find_run_columns(cols, "ndcg10", 3) == ["ndcg10_1", "NDCG10-2", "Ndcg10 3"]
    with pytest.raises(ValueError):
        mode_compare.find_run_columns(cols, "ndcg10", 4)


def test_failed_runs_count_as_zero_when_loaded(spark):
    wide = spark.createDataFrame([(1, -1.0, 0.5, float("nan"))], "request_id bigint, ndcg10_1 double, ndcg10_2 double, `avg_ndcg@10` double")
    row = mode_compare.load_metrics(wide, k=2).first()
    assert row["mean_ndcg"] == 0.25 and row["avg_ndcg_at_10"] == 0.25


def test_modes_must_hold_the_same_requests(spark):
    d = spark.createDataFrame([(1, 0.1), (2, 0.2)], "request_id bigint, m double")
    c = spark.createDataFrame([(1, 0.3)], "request_id bigint, m double")
    with pytest.raises(Exception, match="one mode only"):
        mode_compare.pair_modes(d, c, ["m"]).collect()


def test_requests_without_runs_have_rows(spark):
    schema = "request_id bigint, mode string, run int, text string, num_tokens int"
    runs = spark.createDataFrame([(1, "direct", 1, "[5, 6]", 8)], schema)
    requests = spark.createDataFrame([(1, [5]), (2, [6])], "request_id bigint, truth array<bigint>")
    wanted = requests.select("request_id", F.lit("direct").alias("mode"))
    wide = rec_scores.request_metrics(rec_scores.score_runs(runs, requests), tokens=True, wanted=wanted)
    rows = {r["request_id"]: r for r in wide.collect()}
    assert rows[1]["ndcg10_1"] == 1.0 and rows[1]["avg_tokens"] == 8.0
    assert rows[2]["ndcg10_1"] == -1.0 and rows[2]["avg_ndcg@10"] == 0.0 and rows[2]["avg_tokens"] == 0.0
    truth = spark.createDataFrame([(1, "[A] > [B]"), (2, "[A]")], "request_id bigint, ground_truth string")
    answers = runs.withColumn("text", F.lit("[A] > [B]"))
    scored = ir_scores.score_runs(answers, truth)
    rows = {r["request_id"]: r for r in ir_scores.request_metrics(scored, wanted=wanted).collect()}
    assert rows[1]["avg_top1"] == 1.0 and rows[2]["avg_top1"] == 0.0 and rows[2]["ndcg10_1"] == 0.0


def test_pairwise_accuracy_of_long_lists(spark):
    rng = np.random.default_rng(5)
    lists = []
    for n in (3, 64, 65, 300):
        truth = rng.permutation(n).tolist()
        pred = rng.integers(0, n + 20, n).tolist()
        lists.append((n, [int(x) for x in pred], [int(x) for x in truth] + [int(truth[0])]))
    big = rng.permutation(10_000)
    lists.append((10_000, [int(x) for x in big], list(range(10_000))))
    df = spark.createDataFrame(lists, "n int, pred array<bigint>, truth array<bigint>")
    got = {r.n: r.acc for r in df.select("n", LM.pairwise_accuracy(F.col("pred"), F.col("truth")).alias("acc")).collect()}
    for n, pred, truth in lists:
        place = {x: i for i, x in enumerate(truth)}
        r = np.array([place[x] for x in pred if x in place])
        right = sum(int((r[i + 1 :] > r[i]).sum()) for i in range(len(r)))
        assert got[n] == pytest.approx(right / max(len(r) * (len(r) - 1) / 2, 1))
