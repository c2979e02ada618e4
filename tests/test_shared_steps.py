"""Steps that many queries share: how often they send or work out their rows."""

import contextlib
import hashlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routegauge.functions.digests import MOST, first_words, units
from routegauge.functions.hashing import unit
from routegauge.operators import checklist as C
from routegauge.operators import rec_scores
from routegauge.plans import models, scoring
from routegauge.sources import derived as D
from routegauge.sources import ranges, readers

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_purchases_are_sent_once_behind_the_join(spark, shuffled_joins):
    plan = plan_of(D.requests(spark, SF))
    # line items, orders, and the joined rows to their customer
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("Exchange hashpartitioning(request_id") == 1


def test_answers_are_ranked_and_parsed_once(spark):
    # md5 of the ranking, of the hash of a run, and of the order of the candidates
    runs = D.rec_runs(D.requests(spark, SF))
    assert plan_of(rec_scores.parse_answers(runs)).count("md5(") == plan_of(runs).count("md5(")


def test_records_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"request_id": "req_3", "prompt": "", "outputs": [{"text": "a", "num_tokens": 2}]}',),
                                   ('{"request_id": "req_4", "prompt": "", "outputs": []}',)], "value string")
    runs = readers.explode_outputs(readers.parse_outputs(lines))
    assert plan_of(runs).count("from_json(") == 1
    assert [tuple(r) for r in runs.collect()] == [(3, "", 1, "a", 2)]


def test_runs_with_their_truth_need_no_join(spark):
    requests = D.requests(spark, SF).cache()
    carried = rec_scores.score_runs(D.rec_runs(requests, "truth"), requests)
    joined = rec_scores.score_runs(D.rec_runs(requests), requests)
    assert "Join" not in plan_of(carried).split("InMemoryRelation")[0]
    assert sorted(map(tuple, carried.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)


def test_many_small_ranges_share_tasks(spark):
    most = ranges.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = spark.range(5000).withColumn("size", F.lit(1 << 16))
    assert ranges.spread(rows, F.col("size")).rdd.getNumPartitions() == most
    large = spark.range(most * 2).withColumn("size", F.lit(ranges.TASK_BYTES))
    assert ranges.spread(large, F.col("size")).rdd.getNumPartitions() == most * 2
    assert ranges.spread(rows.limit(3)).rdd.getNumPartitions() == 3
    assert ranges.spread(rows.limit(0)).rdd.getNumPartitions() == 1


def test_digests_of_lists_equal_the_hash_of_each_id(spark):
    """A batch of lists is digested at once; odd ids, empty lists and more texts than a piece holds are among them."""
    rows = [(i, "cot" if i % 3 else "direct", i % 7, [i * 31 + j for j in range(i % 23)] + ([None, -5, 2**63 - 1] if i % 50 == 0 else []))
            for i in range(600)] + [(None, "direct", 1, [1]), (-(2**63), "direct", 6, [-(2**63)])]
    lists = spark.createDataFrame(rows, "request_id long, mode string, run int, ids array<long>")
    each = F.transform("ids", lambda i: unit("request_id", "mode", "run", i))
    found = lists.select(units("request_id", "mode", "run", "ids").alias("found"), each.alias("want")).collect()
    assert [r["found"] for r in found] == [r["want"] for r in found]


def test_digests_equal_md5_at_every_length():
    texts = ["".join(random.Random(n).choices("0123456789:abc", k=n)) for n in range(MOST + 1)]
    assert first_words(pa.array(texts)).tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts]


def test_answers_are_ranked_by_batches(spark):
    """Ranking takes no md5 per run and candidate in Spark's rows: one is left for the hash of the run."""
    req = D.requests(spark, SF).cache()
    plan = plan_of(D.rec_runs(req)).split("InMemoryRelation")[0]
    assert plan.count("md5(") == 1 and "ArrowEvalPython" in plan


def test_margins_are_taken_once_per_vector(spark):
    req = D.requests(spark, SF).cache()
    found, names = models._probed(spark, SF, req)
    assert "ArrowEvalPython" not in plan_of(found)
    each, known = C.margins(D.probe_vectors(spark, SF, req), D.verbalizer_weights(spark, SF, C.verbalizer_sets(D.verbalizer_tokens(spark, SF))))
    assert names == known
    columns = ["request_id", "q", "side", "margins"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, each.select(columns).collect()))


def test_requests_are_dealt_out_before_they_are_answered(spark):
    """A stored file of few requests keeps all cores busy."""
    one = D.requests(spark, SF).coalesce(1).cache()
    plan = plan_of(scoring.rec_wide(spark, SF, req=one)).split("InMemoryRelation")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1
