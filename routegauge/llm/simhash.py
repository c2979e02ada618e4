"""Near-duplicates by SimHash, compared at the anchor points of a covering code.

Fingerprints that differ in at most three bits agree, up to one bit, in their lower or their upper 32 bits. Each half is
kept at its nearest anchor (home) and visits every anchor within the covering radius plus that one bit, so the two meet
where one of them is at home, and are compared there over all 64 bits. Only distinct fingerprints take part, so copies cost
nothing. An anchor with many residents is dealt out in blocks, and its visitors visit every block. A task returns a
spanning forest of the links it finds, never the pairs of a group; components then follow from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import fresh, stored, text_or_empty
from routegauge.llm.components import components
from routegauge.llm.covering import ANCHOR_BITS, anchors, forest
from routegauge.session import ship_package

SEED = 42
BITS = 3
RESIDENTS = 4096
BROADCAST_ROWS = 500_000
_BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: bit majority of the hashes of all ``width``-word shingles (0 without words)."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(len(words) - width + 1, 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        spans = zip(starts[i : min(i + _BLOCK, n)].tolist(), last[i : i + _BLOCK].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, body, fingerprint) of every row, body being a hash of its text.

    Null counts as an empty text, whose fingerprint is zero. Texts are read whole, however long.
    """
    ship_package(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(marks, pa.int64())], names=["doc_id", "body", "fingerprint"])

    body = text_or_empty(text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, body long, fingerprint long")


def _halves(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    bits = values.astype(np.uint64)
    return [(0, (bits & np.uint64(0xFFFFFFFF)).astype(np.int64)), (1, (bits >> np.uint64(32)).astype(np.int64))]


def _placed(with_visits: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for side, half in _halves(values):
                home, more, of = anchors(half)
                keys, owners, is_home = home, np.arange(len(home)), np.ones(len(home), bool)
                if with_visits:
                    keys, owners = np.r_[home, more], np.r_[owners, of]
                    is_home = np.r_[is_home, np.zeros(len(more), bool)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys | side << ANCHOR_BITS), pa.array(values[owners]), pa.array(is_home)],
                    names=["anchor", "value", "home"],
                )

    return apply


_PLACED = "anchor long, value long, home boolean"


def _compare(bits: int):
    """Compare sorted (anchor, block) groups; of the group that a batch ends in, only residents wait for the next."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            parts = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                parts = [np.r_[h, p] for h, p in zip(held, parts, strict=True)]
            key, value, home = parts
            if not len(key):
                continue
            node, root = forest(key, value.astype(np.uint64), home, bits)
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(root.astype(np.int64))], names=["a", "b"])
            stay = (key == key[-1]) & home
            held = [p[stay] for p in parts]

    return apply


def links(values: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between distinct fingerprints (column ``value``)."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover up to three differing bits")
    residents = values.mapInArrow(_placed(False), _PLACED).groupBy("anchor").count().filter(F.col("count") > RESIDENTS)
    hot = residents.select("anchor", F.ceil(F.col("count") / RESIDENTS).cast("int").alias("blocks"))
    placed = values.mapInArrow(_placed(True), _PLACED).join(F.broadcast(hot), "anchor", "left")  # at most 2^19 anchors
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(
        F.col("home"), F.array(F.pmod(F.xxhash64("value"), "blocks").cast("int"))
    ).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    # residents visit the other blocks of their anchor as well
    resident_visits = placed.filter(F.col("home") & F.col("blocks").isNotNull()).select(
        "anchor", "value", F.lit(False).alias("home"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    dealt = placed.select("anchor", "value", "home", F.explode(block).alias("block")).union(resident_visits)
    keyed = dealt.select(F.xxhash64("anchor", "block").alias("k"), "value", "home")
    ordered = keyed.repartition("k").sortWithinPartitions("k", F.desc("home"))
    return ordered.mapInArrow(_compare(bits), "a long, b long").distinct()


def _rooted(marks: DataFrame, bits: int) -> DataFrame:
    """(fingerprint, low, root): the smallest id of every fingerprint, and its component."""
    values = stored(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "simhash-values")
    roots = components(links(values.select(F.col("fingerprint").alias("value")), bits))
    rooted = values.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
    )
    return stored(rooted, "simhash-roots")


def with_components(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """Every row of ``marks`` (doc_id, fingerprint) with component_id: the smallest doc_id reachable over links.

    Equal fingerprints are linked. Null ids are passed over when the smallest is taken; a component without any id has a
    null component_id. An empty table gives an empty result; repeated rows get the same answer each.
    """
    rooted = _rooted(marks, bits)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marks.join(rooted.join(lowest, "root").select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    return with_components(stored(fingerprints(docs, doc_id, text, width), "simhash-marks"), bits)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """One row of every component: that of the smallest id, null ids last. Columns as they were.

    Rows are told apart by id and text: of different texts with the smallest id the one with the smallest hash stays, and a
    row of another component stays whatever its id. Of rows that repeat both, one stays. Empty and null texts are one
    component. An empty table gives an empty result.
    """
    marks = stored(fingerprints(docs, doc_id, text, width), "simhash-marks")
    rooted = marks.join(_rooted(marks, bits).select("fingerprint", "root"), "fingerprint")
    rows = rooted.groupBy("root", "doc_id", "body").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("body"), F.col("rows")))
    kept = stored(rows.groupBy("root").agg(first.alias("x")).select("root", "x.doc_id", "x.body", "x.rows"), "near-kept")
    gone = rooted.select("root", "doc_id", "body").distinct().join(
        kept.select("root", F.col("doc_id").alias("kept_id"), F.col("body").alias("kept_body")), "root"
    ).filter(~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("body") == F.col("kept_body"))))
    key, hashed, own = fresh(docs, "dropped_id", "dropped_body", "body_")

    def few(found: DataFrame) -> DataFrame:
        found = found.select(F.col("doc_id").alias(key), F.col("body").alias(hashed))
        return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found

    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(hashed))
    left = docs.withColumn(own, F.xxhash64(text_or_empty(text))).join(few(stored(gone, "near-copies")), same, "left_anti")
    repeated = kept.filter("rows > 1")
    if not repeated.isEmpty():
        again = few(repeated)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([doc_id, own]))
    return left.drop(own)
