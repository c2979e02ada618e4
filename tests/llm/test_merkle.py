import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routegauge.llm import merkle_manifest
from routegauge.llm.merkle_manifest import expand, fold, octopus, with_proofs

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        if i ^ 1 < len(level):
            yield level[i ^ 1]
        i >>= 1


def brute(rows, tampered):
    """(id, leaf, subroot, root, siblings, verified) of rows of FIELDS."""
    groups = defaultdict(list)
    for r in rows:
        n = r[3] + 1 if r[3] is not None and tampered(r[0]) else r[3]
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:3], n, r[4])), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for b, g in enumerate(names):
        for i, x in enumerate(sorted(groups[g])):
            siblings = [*path(trees[g], i), *path(top, b)]
            yield x[4], x[2], trees[g][-1][0], top[-1][0], siblings, x[2] == x[3]


def test_octopus_asks_for_no_more_than_needed():
    rng = random.Random(4)
    for width in (1, 2, 3, 5, 8, 13, 64, 100):
        tree = levels([sha(str(i)) for i in range(width)])
        some = sorted(rng.sample(range(width), rng.randint(1, width)))
        asked = octopus(some, width)
        assert len(asked) == len(set(asked))
        paths, root = expand({i: tree[0][i] for i in some}, width, {(n, i): tree[n][i] for n, i in asked})
        assert root == tree[-1][0] and paths == {i: list(path(tree, i)) for i in some}
        assert all(fold(tree[0][i], i, width, iter(paths[i])) == root for i in some)
        for left_out in asked:  # every node is needed
            with pytest.raises(KeyError):
                expand({i: tree[0][i] for i in some}, width, {(n, i): tree[n][i] for n, i in asked if (n, i) != left_out})


@pytest.mark.parametrize("bits", [12, 2])
def test_proofs_of_odd_rows(spark, odd, empty, monkeypatch, bits):
    monkeypatch.setattr(merkle_manifest, "BLOCK_BITS", bits)  # small blocks need several rounds
    docs = odd.withColumns({"source": F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("ü"), F.col("doc_id") % 3)), "n_chars": F.length("text")})
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 < 4, F.col("lang")).otherwise("é"))
    docs = docs.withColumns({c: F.lit("x") for c in ("tree", "leaf", "idx", "block", "rn", "branch", "root")})

    def tampered(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 0

    want = sorted(brute([tuple(r[c] for c in FIELDS) for r in docs.collect()], tampered), key=repr)
    change = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = with_proofs(docs, FIELDS, presented={"n_chars": F.when(change, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.siblings, r.folded_root == r.root) for r in got), key=repr) == want
    assert any(not w[-1] for w in want)
    blank = empty.withColumns({"source": F.lit("a"), "n_chars": F.lit(1)})
    assert with_proofs(blank, FIELDS).count() == 0


def test_a_lone_leaf_is_the_root(spark):
    one = spark.createDataFrame([(3, None, "x")], "doc_id long, lang string, text string")
    (r,) = with_proofs(one, ["doc_id", "lang", "text"]).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf((3, None, "x")) and r.siblings == []
