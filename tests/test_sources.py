"""File formats, sinks and session plumbing."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.plans.features import features_of_entries
from routegauge.session import ensure_checkpoint_dir
from routegauge.sources import arrays, ranges, readers, sinks

RECORDS = [
    {"request_id": "req_0", "prompt": "p", "outputs": [{"text": "[1]", "num_tokens": 4}, {"text": "[2]"}]},
    {"request_id": "req_12", "prompt": "q", "outputs": []},
]


@pytest.mark.parametrize("as_array", [True, False])
def test_generation_output_as_array_or_lines(spark, tmp_path, as_array):
    path = tmp_path / "out.jsonl"
    path.write_text(json.dumps(RECORDS, indent=1) if as_array else "\n".join(["", *map(json.dumps, RECORDS), ""]))
    rows = readers.explode_outputs(readers.read_outputs(spark, str(path))).orderBy("run").collect()
    assert [(r["request_id"], r["run"], r["text"], r["num_tokens"]) for r in rows] == [(0, 1, "[1]", 4), (0, 2, "[2]", None)]
    empty = readers.explode_outputs(readers.read_outputs(spark, str(path)), keep_empty=True).filter("run IS NULL").collect()
    assert [r["request_id"] for r in empty] == [12]


def test_files_of_both_formats_in_one_folder(spark, tmp_path):
    folder = tmp_path / "two parts"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(RECORDS, indent=1))
    (folder / "b.jsonl").write_text("\n".join(json.dumps(r | {"request_id": "req_5"}) for r in RECORDS))
    rows = readers.read_outputs(spark, str(folder)).collect()
    assert sorted(r["request_id"] for r in rows) == ["req_0", "req_12", "req_5", "req_5"]
    assert all(r["prompt"] in "pq" for r in rows)


def test_catalogues(spark, tmp_path):
    path = tmp_path / "movies.dat"
    path.write_bytes("1::Amélie (2001)::Comedy|Romance\n2::\"X\"::Drama\n".encode("latin-1"))
    rows = readers.read_items(spark, str(path)).orderBy("item_id").collect()
    assert [tuple(r) for r in rows] == [(1, "Amélie (2001)", "Comedy|Romance"), (2, '"X"', "Drama")]
    csv = tmp_path / "items.csv"
    csv.write_text('item_id,title\n7,"a, b"\n')
    assert [tuple(r) for r in readers.read_items_csv(spark, str(csv)).collect()] == [(7, "a, b")]


def test_chats_and_their_shape(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([[{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], [{"role": "user", "content": "v"}]]))
    bad.write_text("not json")
    assert readers.read_chats(spark, str(good)).count() == 3
    with pytest.raises(Exception, match="array of arrays"):
        readers.read_chats(spark, str(bad)).collect()


def test_rejected_messages(spark):
    lines = spark.createDataFrame([(1, '{"role":"user","content":"x"}'), (2, '{"role":"user"}'), (3, "oops")], "k int, value string")
    good, rejected = readers.parse_messages(lines, ["k"])
    assert [r["k"] for r in good.collect()] == [1]
    assert sorted(r["k"] for r in rejected.collect()) == [2, 3]


def test_entries_with_missing_vectors(spark, tmp_path):
    path = tmp_path / "entries.jsonl"
    path.write_text(json.dumps({"entry_id": 3, "history": [{"item_id": 1, "embedding": [1.0, 2.0]}], "candidates": [{"item_id": 2, "embedding": None}]}) + "\n\n")
    rows = readers.entry_vectors(readers.read_entries(spark, str(path))).orderBy("item_id").collect()
    assert [(r["request_id"], r["section"], r["item_id"], r["vec"]) for r in rows] == [(3, "history", 1, [1.0, 2.0]), (3, "candidate", 2, None)]


def test_features_of_entry_files(spark, tmp_path):
    vec = lambda *v: {"item_id": 1, "embedding": list(v)}
    rec = tmp_path / "rec.jsonl"
    records = [{"history": [vec(1.0, 0.0)], "candidates": [vec(1.0, 0.0), vec(0.0, 1.0)]}, {"history": [], "candidates": []}]
    rec.write_text("\n\n".join(map(json.dumps, records + [records[0] | {"entry_id": "8"}])))
    rows = {r["request_id"]: r for r in features_of_entries(spark, str(rec), "anything").collect()}
    assert len(rows) == 3 and rows[8]["history_candidate_sim_max"] == pytest.approx(1.0)
    assert sorted(r["history_candidate_sim_max"] for r in rows.values()) == pytest.approx([0.0, 1.0, 1.0])
    ir = tmp_path / "ir.jsonl"
    ir.write_text(json.dumps({"entry_id": 4, "query": {"embedding": [3.0, 4.0]}, "candidates": [vec(3.0, 4.0)]}))
    row, = features_of_entries(spark, str(ir), "retrieval").collect()
    assert row["query_norm"] == pytest.approx(5.0) and row["query_candidate_sim_max"] == pytest.approx(1.0)
    broken = tmp_path / "broken.jsonl"
    broken.write_text("{oops")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_entries(spark, str(broken)).collect()


def test_selected_columns(spark, tmp_path):
    path = tmp_path / "cols.json"
    path.write_text('{"selected_cols": ["a", "b"]}')
    assert readers.read_selected_columns(spark, str(path)) == ["a", "b"]
    assert readers.read_selected_columns(spark, str(tmp_path / "none.json")) == []


def test_shards_are_bounded(spark, tmp_path):
    out = str(tmp_path / "entries")
    sinks.write_entries(spark.range(25).coalesce(1), out, shard_size=10)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()]
    assert sorted(sizes) == [5, 10, 10]


def test_checkpoint_folder_is_the_configured_one(spark):
    ensure_checkpoint_dir(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert configured in spark.sparkContext.getCheckpointDir()
    assert spark.sparkContext.getCheckpointDir()


def test_json_arrays_in_many_ranges(spark, tmp_path):
    """Records with brackets, quotes and backslashes inside strings, cut at every place."""
    texts = ['[{"', "}\\", '\\"]', "é\u2028", "\\\\", 'a"b\\\\"c', "", "[[]]" * 9, "x" * 70]
    records = [{"request_id": f"req_{i}", "prompt": t, "outputs": [{"text": t + u, "num_tokens": i} for u in texts]} for i, t in enumerate(texts)]
    for indent, ascii_only in ((None, True), (1, False)):
        path = tmp_path / f"all{indent}.json"
        path.write_text("\n " + json.dumps(records, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
        for size in (37, 1000, 1 << 20):
            found = readers.read_outputs(spark, str(path), size)
            got = {r.request_id: (r.prompt, [(o.text, o.num_tokens) for o in r.outputs]) for r in found.collect()}
            assert got == {r["request_id"]: (r["prompt"], [(o["text"], o["num_tokens"]) for o in r["outputs"]]) for r in records}
    files = ranges.file_sizes(spark, str(path))
    rows = ranges.array_records(files, 300)
    assert rows.rdd.getNumPartitions() > 3
    assert [json.loads(r.value)["request_id"] for r in rows.orderBy("index").collect()] == [r["request_id"] for r in records]
    assert [r["index"] for r in rows.orderBy("index").collect()] == list(range(len(records)))


def test_brackets_outside_strings_equal_a_plain_scan():
    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choice('[]{}"\\\\\\"a,') for _ in range(rng.randint(0, 40))).encode()
        escaped, inside = rng.random() < 0.5, rng.random() < 0.5
        want, esc, ins = [], escaped, inside
        for i, b in enumerate(data):
            c = chr(b)
            if esc:
                esc = False
            elif c == "\\":
                esc = True
            elif c == '"':
                ins = not ins
            elif not ins and c in "[]{}":
                want.append((i, 1 if c in "[{" else -1))
        places, steps, ends, loose = ranges.marks(data, escaped, inside)
        assert [(int(p), int(s)) for p, s in zip(places, steps)] == want
        assert ends == ins and (loose == esc or not data)


def test_npy_round_trip_in_ranges(spark, tmp_path):
    table = spark.range(1000).select(F.col("id"), (F.col("id") * 0.5 - 3).alias("x")).repartition(5)
    arrays.write_npy(table, "id", "x", str(tmp_path / "means"), shard_size=150)
    names = sorted(p.name for p in (tmp_path / "means").iterdir())
    assert names[0] == "part-00000.npy" and len(names) >= 7
    found = arrays.read_npy(spark, str(tmp_path / "means"), range_bytes=400)
    assert [(r.row, list(r["values"])) for r in found.orderBy("row").collect()] == [(i, [i * 0.5 - 3]) for i in range(1000)]
    plain = tmp_path / "one.npy"
    matrix = np.arange(600, dtype=np.float32).reshape(200, 3)
    np.save(plain, matrix)
    found = arrays.read_npy(spark, str(plain), range_bytes=120)
    assert found.rdd.getNumPartitions() > 1
    assert [list(r["values"]) for r in found.orderBy("row").collect()] == matrix.tolist()
    np.save(tmp_path / "bad.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="only plain numbers"):
        arrays.read_npy(spark, str(tmp_path / "bad.npy")).collect()


def test_npz_entries_round_trip(spark, tmp_path):
    rows = [(i % 7, "history" if i % 3 else "candidate", i, None if i == 4 else i * 10, None if i % 11 == 5 else [float(i), 0.5, -1.0]) for i in range(60)]
    table = spark.createDataFrame(rows, "request_id long, section string, pos int, item_id long, vec array<float>").repartition(3)
    arrays.write_entries_npz(table, str(tmp_path / "shards"), shard_size=2)
    shards = sorted((tmp_path / "shards").iterdir())
    assert shards[0].name == "entry_lists_shard000.npz" and len(shards) >= 4
    with np.load(shards[0]) as one:
        assert len(set(one["request_id"].tolist())) <= 2 and one["pooling"].tolist() == ["mean"]
    got = arrays.read_entries_npz(spark, str(tmp_path / "shards"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((*r[:4], r[4] and list(r[4])) for r in rows), key=repr)
