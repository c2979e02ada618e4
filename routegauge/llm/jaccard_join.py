"""Links between documents whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Texts are known by the set of their ``width``-word shingles (64-bit hashes); documents of equal sets are one node. Two
linked sets share a part of their smallest hashes: of the first ``n - ceil(least * n) + slack`` ones at least ``slack``
(``slack`` being a twentieth of the smaller set). Only these are dealt out at first, and nodes with too few keys that another
node has too are left out. Of the others the whole sets are counted, nodes with too few shared shingles left out again, and
of the shared ones the rarest are enough to bring linked nodes together. What meets is a group, and within groups the whole
sets are searched by DivideSkip (``occurrences``): short inverted lists are merged on a heap, long ones probed, and what
reaches the overlap is compared exactly.

Keys that very many nodes share cost no pairs: a key joins its nodes to the smallest of them. Groups beyond one block first
compare every member with one of them; only members not linked to it are then dealt out as residents of blocks, which all
members visit. A task returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge.llm.common import slices, stored, text_or_empty
from routegauge.llm.components import components
from routegauge.llm.occurrences import Forest, Linker
from routegauge.session import ship_package

WIDTH = 5
LEAST = 0.8
WORDS = 1_000_000  # shingles of the residents of a block, about
BROADCAST_ROWS = 1_000_000
SLACK = 20  # one of so many shingles
SEED = 42
_CACHED = 500_000
_rng = np.random.default_rng(SEED)
_PLACES = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes, width: int = WIDTH, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, a text without words none."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    known = {} if known is None else known
    if len(known) > _CACHED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    if not size:
        return hashes.view(np.int64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mix(out * _PLACES[i % 64] + hashes[i : i + n])
    return np.unique(out.view(np.int64))


def bound(n: int, least: Fraction) -> int:
    """Shingles that a set of ``n`` shares at least with any set it is linked to."""
    return -(-n * least.numerator // least.denominator)


def slack(n: int) -> int:
    return max(1, n // SLACK)


def keys_of(n: int, least: Fraction) -> int:
    """How many of its smallest hashes a set of ``n`` is dealt out under."""
    return n - bound(n, least) + min(slack(n), bound(n, least))


def _marks(width: int, least: Fraction):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, 1024):
            nodes, sizes, keys = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), width, known)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                keys.append(found[: keys_of(len(found), least)])
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "body", "node", "n", "keys"],
            )

    return apply


def _confirm(width: int, least: Fraction):
    """Forests of the links within sorted blocks, residents first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        forest, linker, key = Forest(), Linker(least, Forest()), None
        for batch in slices(batches):
            links: list[tuple[int, int]] = []
            for k, node, home, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    key, linker = k, Linker(least, forest)
                links += linker.visit(node, set(shingles(text, width, known).tolist()), home)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
            )

    return apply


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _bound(n: Column, least: Fraction) -> Column:
    return F.ceil(n * least.numerator / F.lit(least.denominator).cast("decimal(20,0)")).cast("long")


def _shared(rows: DataFrame, needed: Column) -> DataFrame:
    """Of (node, n, k), the rows of keys that several nodes have, with their number ``users``, and of nodes with enough of them."""
    live = stored(rows.groupBy("k").agg(F.count("*").alias("users")).filter("users > 1"), "shared-keys")
    met = rows.join(live, "k")
    enough = met.withColumn("shared", F.count("*").over(Window.partitionBy("node"))).filter(F.col("shared") >= needed)
    return stored(enough.select("node", "n", "k", "users", "shared"), "shared-rows")


def _whole(width: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, 64):
            sets = [shingles(t.as_py(), width, known) for t in batch.column(1)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            nodes = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["node", "n", "k"]
            )

    return apply


def survivors(values: DataFrame, least: float = LEAST) -> DataFrame:
    """The nodes (node, n, keys) that share enough of their keys with others to be linked to one of them."""
    share = Fraction(str(least))
    smallest = F.floor(_bound(F.col("n"), share) / SLACK)  # the slack of the smallest set that the node may be linked to
    rows = values.select("node", "n", F.explode("keys").alias("k"))
    return _shared(rows, F.greatest(F.lit(1), smallest)).select("node").distinct()


def candidate_groups(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(node, root) of the sets (node, text) that may be linked to another one: every link lies inside one group.

    Whole sets are counted here. A node goes where fewer of its shingles than the overlap are shared; the rarest of the
    shared ones, as many as an overlap cannot all miss, bring linked nodes together.
    """
    needed = _bound(F.col("n"), Fraction(str(least)))
    rows = texts.mapInArrow(_whole(width), "node long, n long, k long")
    for _ in range(2):  # without the nodes left out, further keys belong to one node only
        rows = _shared(rows.select("node", "n", "k"), needed)
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("users", "k"))
    ranked = stored(rows.withColumn("at", rarest).filter(F.col("at") <= F.col("shared") - needed + 1).select("node", "k"), "rarest-keys")
    low = ranked.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("k", "low")
    return components(ranked.join(low, "k").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())


def _block(*parts) -> Column:
    return F.xxhash64(*parts).alias("k")


def set_links(docs: DataFrame, values: DataFrame, text: str, width: int, least: float) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between distinct sets."""
    body = text_or_empty(text)
    left = stored(survivors(values, least).join(values.select("node", "n", "body"), "node"), "link-survivors")
    texts = docs.select(F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))
    texts = texts.join(_few(left.select("body", "node")), "body").dropDuplicates(["node"]).select("node", "text")
    texts = stored(texts, "link-texts")
    groups = candidate_groups(texts, width, least).withColumnRenamed("root", "of")
    members = stored(groups.join(left.select("node", "n"), "node"), "link-members")

    def confirmed(dealt: DataFrame, label: str) -> DataFrame:
        met = dealt.join(texts, "node").select("k", "node", "home", "text")
        ordered = met.repartition("k").sortWithinPartitions("k", F.desc("home"))
        return stored(ordered.mapInArrow(_confirm(width, Fraction(str(least))), "a long, b long").distinct(), label)

    parts = F.ceil(F.sum("n") / WORDS).cast("int")
    sized = stored(members.groupBy("of").agg(parts.alias("parts"), F.min("node").alias("first")), "link-groups")
    small = members.join(sized.filter("parts = 1"), "of").select(_block("of"), "node", F.lit(True).alias("home"))
    large = stored(members.join(sized.filter("parts > 1"), "of"), "large-groups")
    slice_of = F.pmod(F.xxhash64("node"), "parts").cast("int")
    firsts = large.filter("node = first").select("of", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"))
    visits = large.filter("node <> first").select(_block("of", slice_of), "node", F.lit(False).alias("home"))
    found = confirmed(small.unionByName(firsts.select(_block("of", "slice"), "node", F.lit(True).alias("home"))).unionByName(visits), "links")

    near = found.join(large.select("first").distinct(), F.col("b") == F.col("first"), "left_semi").select(F.col("a").alias("node"))
    rest = large.filter("node <> first").join(near.distinct(), "node", "left_anti")
    blocks = rest.groupBy("of").agg(parts.alias("blocks"))
    of_rest = rest.select("node", F.lit(True).alias("rests"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    dealt = large.filter("node <> first").join(blocks, "of").join(of_rest, "node", "left").select("of", "node", "rests", own.alias("own"), every)
    home = F.coalesce("rests", F.lit(False)) & (F.col("block") == F.col("own"))
    return found.unionByName(confirmed(dealt.select(_block("of", "block"), "node", home.alias("home")), "further-links"))


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the smallest id reachable over links.

    Null texts count as empty; a text without words has an empty set, linked with nothing, and its own id. Null ids are
    passed over when the smallest is taken; a component without any id has a null component_id. Rows that repeat get the
    same answer each. Texts are read whole, however long; other columns do not matter. An empty table gives no rows.
    """
    if not 0 < least <= 1 or not 1 <= width <= 64:
        raise ValueError("least lies above 0 and up to 1, width from 1 to 64")
    ship_package(docs.sparkSession)
    body = text_or_empty(text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))
    schema = "doc_id long, body long, node long, n long, keys array<long>"
    marks = stored(rows.mapInArrow(_marks(width, Fraction(str(least))), schema), "shingle-sets")
    sets = marks.filter("n > 0")
    lows = stored(sets.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")), "shingle-nodes")
    repeated = _few(lows.filter("rows > 1").select("node"))
    once = sets.join(repeated, "node", "left_anti").select("node", "n", "body", "keys")
    copies = sets.join(repeated, "node", "left_semi").select("node", "n", "body", "keys").dropDuplicates(["node"])
    roots = components(set_links(docs, once.unionByName(copies), text, width, least))
    rooted = lows.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "shingle-roots")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = rooted.join(lowest, "root").select("node", "component_id", F.lit(True).alias("known"))
    return marks.drop("keys").join(answers, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
