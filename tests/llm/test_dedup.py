import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from routegauge.llm import covering, exact_dedup, line_dedup, simhash
from routegauge.llm.components import components
from routegauge.llm.edit_distance import probes, segments, within


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_grace_merge_spills_and_compares_contents():
    rows = [(7, bytes([65 + i % 5]) * 40, i, 1, 1) for i in range(200)]  # one hash: no bits tell the contents apart
    rows.append((7, b"A" * 40, None, 1, 1))
    got = sorted(exact_dedup.grace_merge(rows, budget=300))
    assert [(c[:1], k, m, n) for _, c, k, m, n in got] == [(bytes([65 + i]), i, 1, 40 + (i == 0)) for i in range(5)]


def test_exact_groups(odd, empty):
    want = defaultdict(list)
    for r in odd.collect():
        want[norm(r.text)].append(r.doc_id)
    got = exact_dedup.with_groups(odd, budget=2000).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = want[norm(r.text)]
        low = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (low, len(ids), r.doc_id == low)
        assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
    assert exact_dedup.with_groups(empty).count() == 0


def test_drop_copies_keeps_one_row(odd, empty):
    kept = exact_dedup.drop_copies(odd, budget=2000)
    assert kept.columns == odd.columns and exact_dedup.drop_copies(empty).count() == 0
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(r.text) for r in odd.collect()})


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_words_one_bit_apart_meet_at_an_anchor():
    x = np.random.default_rng(2).integers(0, 1 << 32, 3000)
    for bit in range(32):
        home, _, _ = covering.anchors(x)
        near, more, of = covering.anchors(x ^ 1 << bit)
        met = home == near
        np.logical_or.at(met, of, more == home[of])
        assert met.all()


def test_fingerprints_and_components(odd, empty):
    rows = odd.collect()
    prints = np.array([brute_fingerprint(r.text) for r in rows], dtype=np.uint64)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = label[i], label[int(j)]
            label = [min(a, b) if x in (a, b) else x for x in label]
    want = []
    for r, p, c in zip(rows, prints, label, strict=True):
        ids = [s.doc_id for s, d in zip(rows, label, strict=True) if d == c and s.doc_id is not None]
        want.append((r.doc_id, int(p), min(ids, default=None)))
    got = [(r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and simhash.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_hot_anchors_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RESIDENTS", 4)
    values = [1 << 40 | i for i in range(64)]  # neighbours of one another at few anchors
    marks = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fingerprint long")
    assert {r.component_id for r in simhash.with_components(marks).collect()} == {0}


def test_rows_of_one_id_with_different_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (5, text + " "), (5, "quite another text of its own"), (7, "a third one altogether different"), (7, "a third one altogether different")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (simhash.drop_near_duplicates(docs), corpus_pipeline.near(spark, docs, "")):
        assert sorted(tuple(r) for r in found.collect()) == sorted({rows[0], rows[2], rows[3]})


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_probes():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        a = "".join(rng.choice(list("abc"), rng.integers(3, 14)))
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abc"), rng.integers(0, 2)))
        b = "".join(b)
        d = plain_distance(a, b)
        assert [within(a, b, m) for m in (1, 2, 3)] == [d <= m for m in (1, 2, 3)]
        long, short = sorted((a, b), key=len, reverse=True)
        if d <= 2 and len(short) >= 3:
            index = {(len(short), i, short[p : p + n]) for i, (p, n) in enumerate(segments(len(short), 2))}
            assert any((o, i, long[p : p + n]) in index for o, i, p, n in probes(len(long), 2))


def test_repeated_lines(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(line_dedup, "RESIDENTS", 3)
    variants = ["the quick brown fox jumps over it"] + [f"the quick brown fox jumps over i{c}" for c in "abcdefgh"]
    extra = spark.createDataFrame(
        [(1000 + i, f"{v}\n\nab\n{chr(97 + i) * 9}", "en", "z", "q") for i, v in enumerate(variants)], odd.schema
    )
    docs = odd.union(extra)
    places, texts = [], {}
    for r in {(r.doc_id, r.text) for r in docs.collect()}:
        for no, h, line in line_dedup.lines_of((r[1] or "").encode()):
            body = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
            places.append(((r[0] is not None, r[0] or 0), no, body - (1 << 64) if body >> 63 else body, h, r[0]))
            texts[h] = line.decode()
    root = {h: h for h in texts}
    for a in texts:
        for b in texts:
            x, y = texts[a], texts[b]
            most = line_dedup.allowed(min(len(x), len(y)))
            if a < b and abs(len(x) - len(y)) <= most and len(x) < 500 and plain_distance(x, y) <= most:
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    seen, want = set(), defaultdict(set)
    for _, no, body, h, doc_id in sorted(places, key=lambda p: p[:3]):
        if root[h] in seen:
            want[doc_id, body].add(no)
        seen.add(root[h])
    found = line_dedup.with_line_report(docs)
    assert found.count() == docs.count()
    for r in found.collect():
        body = xxhash.xxh64_intdigest((r.text or "").encode(), 42)
        key = r.doc_id, body - (1 << 64) if body >> 63 else body
        assert r.dropped == sorted(want[key]) == [x["no"] for x in r.repeats], r.doc_id
        for x in r.repeats:
            own = next(p[3] for p in places if p[4] == r.doc_id and p[2] == key[1] and p[1] == x["no"])
            head = next(p for p in sorted(places, key=lambda p: p[:3]) if root[p[3]] == root[own])
            assert (x["head_id"], x["head_no"], x["variants"]) == (head[4], head[1], sum(v == root[own] for v in root.values()))
        assert r.n_lines == len(list(line_dedup.lines_of((r.text or "").encode())))
    assert line_dedup.with_line_report(empty).count() == 0
    clash = docs.withColumns({c: F.lit("z") for c in ("key", "body", "found_key", "h", "no", "line_key_", "Repeats", "own_body_")})
    assert line_dedup.with_line_report(clash).filter("n_lines > 0").count() == found.filter("n_lines > 0").count()
    assert line_dedup.without_repeated_lines(clash).columns == clash.columns
    cleaned = line_dedup.without_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    assert {r.text for r in cleaned.collect() if r.doc_id == 1003} == {"\nddddddddd"}


def test_a_hot_segment_of_many_lines(spark):
    rng = np.random.default_rng(9)
    heads = ["".join(map(chr, rng.integers(97, 123, 10))) for _ in range(50_000)]
    lines = [f"{h}shared middlelast{h[::-1]}" for h in heads]  # all share their middle segment
    close = [x[:-1] + "!" for x in lines[:200]]
    rows = [(i, "\n".join(lines[i::40])) for i in range(40)] + [(100, "\n".join(close))]
    found = line_dedup.with_line_report(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.filter("size(dropped) > 0").collect()}
    assert set(got) == {100} and got[100].dropped == list(range(200))
    assert [(x["head_id"], x["head_no"]) for x in got[100].repeats] == [(i % 40, i // 40) for i in range(200)]
