"""Answers and candidates that are put in order a batch at a time, and answers that are searched once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.functions.answers import rec_ids
from routegauge.functions.digests import best_ids, leading, shuffled
from routegauge.functions.hashing import unit
from routegauge.session import ship_package
from routegauge.sources import derived as D
from test_shared_steps import SF, plan_of


def lists(spark):
    ship_package(spark)
    rows = [(i, "cot" if i % 3 else "direct", i % 7, [i * 31 + j for j in range(i % 23)] + ([None, -5, 2**63 - 1] if i % 50 == 0 else []), [i * 31 + 2, -5])
            for i in range(600)] + [(None, "direct", 1, [3, 1], [1]), (7, "cot", 2, None, [1])]
    return spark.createDataFrame(rows, "request_id long, mode string, run int, ids array<long>, truth array<long>").coalesce(2)


def test_best_ids_equal_a_sort_of_every_answer(spark):
    bonus = F.when(F.col("mode") == "cot", F.lit(0.35)).otherwise(F.lit(0.05))
    hits = F.transform("ids", lambda i: F.array_contains("truth", i))

    def key(i):
        lift = F.when(F.array_contains("truth", i), bonus).otherwise(F.lit(0.0))
        return F.struct((-(unit("request_id", "mode", "run", i) + lift)).alias("k"), i.alias("id"))

    want = F.slice(F.transform(F.sort_array(F.transform("ids", key)), lambda s: s["id"]), 1, 10)
    found = best_ids("request_id", "mode", "run", "ids", hits, bonus, F.lit(10))
    rows = lists(spark).select(found.alias("found"), want.alias("want")).collect()
    assert [r["found"] for r in rows] == [r["want"] for r in rows]


def test_shuffled_ids_are_in_the_order_of_the_whole_digest(spark):
    def key(i):
        return F.struct(F.md5(F.concat_ws(":", F.col("request_id"), i)).alias("k"), i.alias("id"))

    want = F.transform(F.sort_array(F.transform("ids", key)), lambda s: s["id"])
    given = lists(spark).select("request_id", F.col("ids").alias("candidates"), want.alias("want"))
    rows = given.mapInArrow(shuffled, given.schema).collect()
    assert len(rows) == 602 and [r["candidates"] for r in rows] == [r["want"] for r in rows]


def test_equal_keys_go_by_the_next_key_and_then_by_the_id():
    rng = random.Random(3)
    given = [[rng.choice([None, *range(9)]) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    given = [list(dict.fromkeys(ids)) for ids in given]
    n = sum(map(len, given))
    first, second = (np.array([rng.randint(0, 2) for _ in range(n)], np.uint64) for _ in range(2))
    want, at = [], 0
    for ids in given:
        keyed = [(first[at + j], second[at + j], x is not None, x or 0, x) for j, x in enumerate(ids)]
        want.append([k[-1] for k in sorted(keyed, key=lambda k: k[:-1])][:4])
        at += len(ids)
    assert leading(pa.array(given, pa.list_(pa.int64())), 4, first, second).to_pylist() == want
    largest = np.full(3, np.iinfo(np.uint64).max, np.uint64)
    assert leading(pa.array([[5, 4], [6]]), 9, largest).to_pylist() == [[4, 5], [6]]


def test_candidates_are_shuffled_by_batches(spark):
    plan = plan_of(D.requests(spark, SF))
    assert "md5(" not in plan and plan.count("MapInArrow") == 2


def test_answers_are_searched_once_for_every_form(spark):
    plan = plan_of(spark.createDataFrame([("a",)], "text string").select(rec_ids(F.col("text")).alias("ids")))
    # one search for each of the two forms that start with the same words, one of them tagged
    assert plan.count("<output>") == 1 and plan.count("(?isU)") == 2


def test_digits_of_a_match_are_those_of_its_list(spark):
    marks = ["<output>", "</output>", "Ranking result: ", "recommendation  RESULT:", "[", "]", "12", "7, 8", "٣", "，", "\n", "x5", " ", "none", ""]
    rng = random.Random(8)
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 9))) for _ in range(3000)]
    texts += ["<output>" + a + b + "</output>9" for a in marks for b in marks] + [None]

    def either(text, pattern):
        return F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))

    text = F.coalesce("text", F.lit(""))
    body = (
        F.when(text.rlike(fv.REC_TAGGED), either(text, fv.REC_TAGGED)).when(text.rlike(fv.REC_INLINE), either(text, fv.REC_INLINE))
        .when(text.rlike(fv.REC_BARE_LIST), text).otherwise(F.regexp_extract(text, fv.REC_BRACKET, 1))
    )
    want = F.regexp_extract_all(body, F.lit(r"(\d+)"), F.lit(1)).cast("array<bigint>")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rec_ids(F.col("text")).alias("found"), want.alias("want")).collect()
    assert [(r["text"], r["found"]) for r in rows] == [(r["text"], r["want"]) for r in rows]
