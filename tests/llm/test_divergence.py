import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from routegauge.llm import divergence
from routegauge.llm.divergence import audit, terms
from routegauge.llm.transducer import Transducer, build


def test_transducer_is_minimal_and_gives_ordinals():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abcd\xc3\xa9") for _ in range(rng.randint(0, 7))) for _ in range(3000)})
    made = Transducer.unpack(build(words).pack())
    assert [made.ordinal(w) for w in words] == list(range(len(words)))
    others = {bytes(rng.choice(b"abcdz") for _ in range(rng.randint(0, 9))) for _ in range(3000)} - set(words)
    assert all(made.ordinal(w) == -1 for w in others)
    endings = {}  # states of a minimal automaton accept different sets of endings
    for w in words:
        for i in range(len(w) + 1):
            endings.setdefault(w[:i], set()).add(w[i:])
    states = {k >> 8 for k in made.arcs} | {v >> 32 for v in made.arcs.values()}
    assert len(states) == len({frozenset(e) for e in endings.values()})
    assert build([]).ordinal(b"") == -1


def test_terms():
    text = "Das Übel: über-ÄRGER, x2y __Zz\x7fq\n ß"
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in terms(text.encode())] == want


def brute(rows, least, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in rows]
    used, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (lang, source, _), w in zip(rows, words, strict=True):
        used[lang].update(set(w))
        groups[lang].add(source)
    for (lang, source, _), w in zip(rows, words, strict=True):
        counts[lang, source].update(x for x in w if used[lang][x] >= least)
    out = []
    for lang, sources in groups.items():
        kept = [x for x, n in used[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def p(c, x, kept=kept):
            return 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept))

        for s in sources:
            mine = counts[lang, s]
            pairs = [(sum((p(mine, x) - p(o, x)) ** 2 // (p(mine, x) + p(o, x)) for x in kept), t) for t in sources - {s} for o in [counts[lang, t]]]
            over = [((p(mine, x) - p(whole, x)) ** 2 // (p(mine, x) + p(whole, x)), x) for x in kept if mine[x] and p(mine, x) > p(whole, x)]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" if i % 5 else f"W{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(300)]
    rows = [(rng.choice(["en", "de", None]), f"s{rng.randint(0, 8)}" if rng.random() < 0.9 else None,
             " ".join(rng.choice(words[: rng.choice([30, 300])]) for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    rows += [("fr", "s1", "once only"), ("fr", "s2", None), ("en", "bare", "12 34"), ("en", "Bare", ""), *rows[:5]]
    return rows


def test_audit_against_brute_force(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "lang string, source string, text string")
    docs = docs.withColumns({c: F.lit(0) for c in ("term", "n", "ordinal", "size", "value", "rank", "item", "part")})
    want = brute(corpus, 10)
    assert sorted(tuple(r) for r in audit(docs).collect()) == want
    monkeypatch.setattr(divergence, "SHARD_TERMS", 16)  # several shards, passes, blocks and tiles
    monkeypatch.setattr(divergence, "ORDINALS", 8)
    monkeypatch.setattr(divergence, "TILE", 3)
    for held in ("HELD_TERMS", "HELD_OCCURRENCES", "KEPT_WORDS"):
        monkeypatch.setattr(divergence, held, 50)
    assert sorted(tuple(r) for r in audit(docs, block_bytes=2000).collect()) == want


def test_nothing_kept_and_empty_tables(spark, odd, empty):
    rows = odd.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a"))
    want = brute([(r.lang, r.source, r.text) for r in rows.collect()], 10**6)
    assert want and sorted(tuple(r) for r in audit(rows, least=10**6).collect()) == want
    assert audit(empty.withColumn("source", F.lit("a"))).count() == 0
