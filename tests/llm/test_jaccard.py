import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.llm import jaccard_join
from routegauge.llm.jaccard_join import linked_documents
from routegauge.llm.occurrences import Forest, Linker, Occurrences


def brute(rows, width=5):
    """(id, size of the set, smallest id of the component) by all pairs."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", (text or "").encode().lower()) if w]
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set())
    label, pairs = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = [min((r[0] for r, d in zip(rows, label, strict=True) if d == c and r[0] is not None), default=None) for c in label]
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, low, strict=True)), key=repr), pairs


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_occurrences_by_divide_skip():
    rng = random.Random(3)
    sets = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(200)]
    index = Occurrences()
    for i, s in enumerate(sets):
        index.add(i, s)
    for _ in range(200):
        asked, least = set(rng.sample(range(70), rng.randint(1, 40))), rng.randint(1, 20)
        want = {i: n for i, s in enumerate(sets) if (n := len(asked & set(s))) >= least}
        assert dict(index.search(asked, least)) == want


def test_linker_finds_every_component():
    rng = random.Random(1)
    for _ in range(40):
        base = [set(rng.sample(range(400), rng.randint(1, 60))) for _ in range(6)]
        sets = {}
        for i in range(rng.randint(2, 60)):
            one = set(rng.choice(base)) | {rng.randint(0, 400)}
            for _ in range(rng.randint(0, 5)):
                one.discard(rng.choice(sorted(one)) if len(one) > 1 else None)
            sets[i] = one
        forest = Forest()
        linker = Linker(Fraction(4, 5), forest)
        links = [x for i, s in sets.items() for x in linker.visit(i, s, True)]
        assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in links)
        label = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    x, y = label[a], label[b]
                    label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        assert {i: forest.root(i) for i in sets} == label


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    passage, texts = " ".join(rng.choice(words, 60)), []
    for i in range(40):
        base = list(rng.choice(words, int(rng.integers(20, 400))))
        texts.append(" ".join(base))
        for changes in (1, 2, 4, 8, 12):  # similarities from 0.2 to 0.98
            copy = list(base)
            for at in rng.integers(0, len(copy), changes * len(base) // 200 + i % 2):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choice(words, int(n))) for n in rng.integers(5, 60, 30)]  # one passage, hardly more
    return list(enumerate(texts))


def test_links_against_all_pairs(spark, copies, monkeypatch):
    want, pairs = brute(copies)
    assert pairs > 100
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert found(linked_documents(docs)) == want
    monkeypatch.setattr(jaccard_join, "WORDS", 100)  # groups of several blocks
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert found(linked_documents(docs)) == want


def test_odd_rows_and_clashing_names(spark, odd, empty):
    want, _ = brute([(r.doc_id, r.text) for r in odd.collect()])
    clash = odd.withColumns({c: F.lit(1) for c in ("node", "n", "k", "keys", "body", "component_id", "n_shingles", "low", "root")})
    assert found(linked_documents(clash)) == want
    assert linked_documents(empty).count() == 0
    with pytest.raises(ValueError):
        linked_documents(odd, least=0)


def test_texts_below_five_words(spark):
    rows = [(4, "a b"), (3, "A  b"), (2, "a b c"), (1, ""), (0, None), (9, " \n")]
    got = found(linked_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == [(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 1, 3), (4, 1, 3), (9, 0, 9)]
