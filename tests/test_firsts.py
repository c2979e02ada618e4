"""Distinct items in order, from sorted rows: against a plain scan, whatever the batches."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routegauge.functions import firsts
from routegauge.sources import derived as D


def scanned(rows):
    out = []
    for group, item in rows:
        if not out or out[-1][0] != group:
            out.append((group, []))
        if item not in out[-1][1]:
            out[-1][1].append(item)
    return out


@pytest.mark.parametrize("cut", [1, 3, 50, 10_000])
def test_lists_do_not_depend_on_batches(cut):
    rng = random.Random(cut)
    rows = [(None, 0), (None, None), (0, 0), (0, None), (0, 0)]
    for group in range(1, 40):
        rows += [(group, rng.choice([None, 0, *range(rng.randint(1, 30))])) for _ in range(rng.choice([1, 2, 30, 300]))]
    rows += [(99, i % 700) for i in range(3000)]
    batches = [
        pa.RecordBatch.from_pydict({"g": pa.array([r[0] for r in part], pa.int64()), "x": pa.array([r[1] for r in part], pa.int64())})
        for part in (rows[at : at + cut] for at in range(0, len(rows), cut))
    ]
    empty = batches[0].slice(0, 0)
    found = [r for b in firsts.distinct_lists(iter([empty, *batches, empty])) for r in b.to_pylist()]
    assert [(r["g"], r["x"]) for r in found] == scanned(rows)
    assert list(firsts.distinct_lists(iter([empty]))) == []


def test_only_distinct_items_of_a_group_are_held(monkeypatch):
    """A customer that buys 50 items again and again, in 400 batches."""
    seen, plain = [], firsts.distinct_in_order
    monkeypatch.setattr(firsts, "distinct_in_order", lambda t: seen.append(len(t)) or plain(t))
    batch = pa.RecordBatch.from_pydict({"g": [7] * 200, "x": [i % 50 for i in range(200)]})
    (found,) = [r for b in firsts.distinct_lists(iter([batch] * 400)) for r in b.to_pylist()]
    assert found == {"g": 7, "x": list(range(50))} and max(seen) <= 250


def test_requests_hold_items_in_the_order_first_bought(spark, tmp_path):
    """Repeated purchases, a customer of many batches, equal dates and lines that share a number."""
    orders = [(o, 1 if o % 2 else 2 + o % 5, f"2020-01-{1 + o * 7 % 28:02d}") for o in range(4000)]
    line = [(o, n // 2, (o * 13 + n * n) % 900) for o, _, _ in orders for n in range(1 + o % 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").withColumn("o_orderdate", F.col("d").cast("date")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(900).write.parquet(f"{tmp_path}/part.parquet")
    bought = {}
    date = {o: (c, d) for o, c, d in orders}
    for _, o, n, x in sorted((date[o][1], o, n, x) for o, n, x in line):
        bought.setdefault(date[o][0], dict.fromkeys([])).setdefault(x)
    req = D.requests(spark, str(tmp_path))
    plan = req._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan and "collect_list(" not in plan
    found = {r["request_id"]: r["history"] + r["truth"] for r in req.collect()}
    assert found == {c: list(items) for c, items in bought.items() if len(items) > 3}
