"""A Merkle manifest of a table with an inclusion proof for every row, by octopus multiproofs.

Rows are leaves; the rows of one group form a tree, and the roots of these trees, in the order of the groups, form a tree
of their own. While several nodes remain, every two consecutive ones become the digest of both (a lone last one the digest
of itself). Trees are grown in rounds of twelve levels over aligned blocks, so a task never holds more than 4,096 nodes
of one block, whatever share of the rows one group has.

A leaf partition is one block of leaves. It works out the smallest set of node coordinates that all its proofs lack
(``octopus``), gets these once, derives the interior nodes that its proofs share, and writes out each proof by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import batches_of, stored
from routegauge.operators.ranking import with_rank
from routegauge.session import ship_package

BLOCK_BITS = 12
TOP = ""  # the tree of the groups' roots; trees of groups are named 0 (null group) or 1 and the group
_NODES = "tree string, level int, idx long, digest string, width long, last boolean"
_ASKED = "tree string, block long, level int, idx long"
_PROOFS = (
    "doc_id long, leaf string, presented string, position long, leaves long, branch long, branches long, "
    "subroot string, root string, siblings array<string>, folded_root string"
)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    body = value.cast("string")
    return F.when(body.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def octopus(leaves: Iterable[int], width: int) -> list[tuple[int, int]]:
    """The (level, index) of the fewest nodes that, with these leaves, give the proofs of all of them."""
    known, level, lacking = sorted(set(leaves)), 0, []
    while width > 1:
        have = set(known)
        lacking += [(level, i ^ 1) for i in known if i ^ 1 < width and i ^ 1 not in have]
        known, width, level = sorted({i >> 1 for i in known}), (width + 1) >> 1, level + 1
    return lacking


def expand(leaves: dict[int, str], width: int, fetched: dict[tuple[int, int], str]) -> tuple[dict[int, list[str]], str]:
    """The siblings of every leaf from the bottom to the top, and the root; interior nodes are derived once for all."""
    here, level, levels = dict(leaves), 0, []
    while width > 1:
        full = dict(here)
        for i in here:
            if i ^ 1 not in full and i ^ 1 < width:
                full[i ^ 1] = fetched[level, i ^ 1]
        levels.append((here, full))
        here = {p: digest(full[2 * p], full.get(2 * p + 1, "")) for p in {i >> 1 for i in here}}
        width, level = (width + 1) >> 1, level + 1
    (root,) = here.values()
    above: dict[int, list[str]] = {0: []}
    for own, full in reversed(levels):
        above = {i: ([full[i ^ 1]] if i ^ 1 in full else []) + above[i >> 1] for i in own}
    return above, root


def fold(start: str, index: int, width: int, siblings: Iterator[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    while width > 1:
        if index ^ 1 >= width:
            start = digest(start)
        else:
            start = digest(next(siblings), start) if index & 1 else digest(start, next(siblings))
        index, width = index >> 1, (width + 1) >> 1
    return start


def _climb(inner: bool):
    """Up to twelve levels above one aligned block of nodes; without ``inner`` only the last of them is given."""

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, level, width = (table.column(c)[0].as_py() for c in ("tree", "level", "width"))
        start, nodes, out = table.column("idx")[0].as_py(), table.column("digest").to_pylist(), []
        for step in range(1, BLOCK_BITS + 1):
            if width <= 1:
                break
            nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            start, width, level = start >> 1, (width + 1) >> 1, level + 1
            last = step == BLOCK_BITS or width == 1
            if inner or last:
                out += [(tree, level, start + i, d, width, last) for i, d in enumerate(nodes)]
        schema = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()),
                            ("width", pa.int64()), ("last", pa.bool_())])
        return pa.Table.from_batches(batches_of(out, schema), schema)

    return apply


def grow(leaves: DataFrame, label: str, inner: bool = True) -> DataFrame:
    """The nodes above leaves (tree, level, idx, digest, width), width being the nodes of the tree on that level.

    Without ``inner`` the nodes inside the blocks of leaves are left out; every proof of a block derives these itself.
    """
    found, front = None, leaves
    while True:
        block = F.shiftright("idx", BLOCK_BITS).alias("block")
        layer = stored(front.groupBy("tree", block).applyInArrow(_climb(inner), _NODES), label)
        found, inner = layer if found is None else found.unionByName(layer), True
        front = layer.filter("last AND width > 1").drop("last")
        if front.isEmpty():
            return found.drop("last")


def _asked_by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        asked = ((tree, block, *node) for tree, block, low, high, width in rows for node in octopus(range(low, high + 1), width))
        yield from batches_of(asked, schema)


def _fetched(parts: DataFrame, nodes: DataFrame, name: str, of: Column) -> DataFrame:
    """(tree, block, name): the nodes that each part lacks, at most two for every level above its block."""
    asked = parts.mapInArrow(_asked_by_blocks, _ASKED).withColumn("of", of)
    known = nodes.select(F.col("tree").alias("of"), "level", "idx", "digest")
    return asked.join(known, ["of", "level", "idx"]).groupBy("tree", "block").agg(
        F.collect_list(F.struct("level", "idx", "digest")).alias(name)
    )


def _prove(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("presented", pa.string()), ("position", pa.int64()),
                        ("leaves", pa.int64()), ("branch", pa.int64()), ("branches", pa.int64()), ("subroot", pa.string()),
                        ("root", pa.string()), ("siblings", pa.list_(pa.string())), ("folded_root", pa.string())])
    part = right.to_pylist()[0]
    own, top = ({(x["level"], x["idx"]): x["digest"] for x in part[c] or ()} for c in ("own", "top"))
    branch, branches, leaves = part["branch"], part["branches"], part["leaves"]
    rows = left.select(["idx", "doc_id", "leaf", "presented"]).to_pylist()
    paths, subroot = expand({r["idx"]: r["leaf"] for r in rows}, leaves, own)
    above, root = expand({branch: subroot}, branches, top)

    def proofs():
        for r in rows:
            i, siblings = r["idx"], paths[r["idx"]] + above[branch]
            rest = iter(siblings)
            got = fold(fold(r["presented"], i, leaves, rest), branch, branches, rest)
            yield r["doc_id"], r["leaf"], r["presented"], i, leaves, branch, branches, subroot, root, siblings, got

    return pa.Table.from_batches(batches_of(proofs(), schema), schema)


def with_proofs(
    docs: DataFrame, fields: list[str], group: str = "lang", doc_id: str = "doc_id", presented: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, its place (position of leaves, branch of branches), subroot, root,
    siblings (from the leaf up to the root) and folded_root, the root that the presented leaf and the siblings lead to.

    ``presented`` replaces fields in the rows that are to be verified, by column expressions; without it the rows
    themselves are verified. Nulls are encoded apart from every value; a null group comes first, null ids come first in
    their group. Rows of equal id are ordered by their digests; rows that repeat wholly are leaves of their own with
    proofs of their own. Texts of any length are digested inside Spark and never reach Python. Other columns do not
    matter. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    shown = {c: (presented or {}).get(c, F.col(f"`{c}`")) for c in fields}
    changed = F.lit(False)
    for c in presented or {}:
        changed = changed | ~shown[c].eqNullSafe(F.col(f"`{c}`"))
    name = F.col(f"`{group}`").cast("string")
    rows = docs.select(
        F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)).alias("tree"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        leaf_digest(F.col(f"`{c}`") for c in fields).alias("leaf"),
        F.when(changed, leaf_digest(shown[c] for c in fields)).alias("other"),
    )
    rows = stored(rows, "merkle-rows").withColumn("presented", F.coalesce("other", "leaf")).drop("other")
    placed = with_rank(rows, [F.asc("doc_id"), F.asc("leaf"), F.asc("presented")], by=("tree",), rank="rn", size="leaves")
    placed = stored(placed.withColumn("idx", F.col("rn") - 1).withColumn("block", F.shiftright("idx", BLOCK_BITS)).drop("rn"), "merkle-leaves")

    leaves = placed.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), F.col("leaves").alias("width"))
    nodes = grow(leaves, "merkle-nodes", inner=False)
    subroots = nodes.unionByName(leaves).filter("width = 1").select("tree", "digest")
    trees = with_rank(subroots, [F.asc("tree")], rank="rn", size="branches").withColumn("branch", F.col("rn") - 1).drop("rn")
    trees = stored(trees, "merkle-trees")
    tops = trees.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("branch").alias("idx"), "digest", F.col("branches").alias("width"))
    top_nodes = tops.unionByName(grow(tops, "merkle-top"))

    parts = placed.groupBy("tree", "block").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.max("leaves").alias("leaves"))
    own = _fetched(parts, nodes, "own", F.col("tree"))
    places = trees.select("tree", F.lit(0).cast("long").alias("block"), F.col("branch").alias("low"), F.col("branch").alias("high"), "branches")
    top = _fetched(places, top_nodes, "top", F.lit(TOP)).drop("block")
    known = parts.join(own, ["tree", "block"], "left").join(trees.drop("digest").join(top, "tree", "left"), "tree")
    known = known.select(F.col("tree").alias("of"), F.col("block").alias("part"), "leaves", "branch", "branches", "own", "top")
    leaf_parts = placed.select("tree", "block", "idx", "doc_id", "leaf", "presented").groupBy("tree", "block")
    return leaf_parts.cogroup(known.groupBy("of", "part")).applyInArrow(_prove, _PROOFS)
