"""Exact deduplication with Grace hashing.

Spark's exchange deals the texts out by hash: that is the first level of partitions, kept in shuffle files. A task
then fills an open-addressing table (a ``dict`` keyed by the whole content, so that probing compares complete texts)
until its memory budget is used; what no longer fits goes to spill files by further bits of the hash, and every spill
file is treated in the same way. Before the exchange each task merges its own copies, so a text that makes up a third
of all rows reaches its bucket as one row per task.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import batches_of, fresh, stored, text_or_empty

FANOUT_BITS = 4
_ROW_OVERHEAD = 200
_HEAD = struct.Struct("<qqqqB")
_PARTIAL = pa.schema(
    [("hash", pa.int64()), ("content", pa.binary()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("rows", pa.int64())]
)
_GROUPS = pa.schema(
    [("digest", pa.string()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("group_size", pa.int64())]
)

Row = tuple[int, bytes, "int | None", int, int]


def _merged(a: list, keep_id: int | None, keep_rows: int, rows: int) -> None:
    """Add a row to a table entry [hash, smallest id, rows with that id, rows]; a null id comes last."""
    if a[1] == keep_id:
        a[2] += keep_rows
    elif a[1] is None or (keep_id is not None and keep_id < a[1]):
        a[1], a[2] = keep_id, keep_rows
    a[3] += rows


def grace_merge(rows: Iterable[Row], budget: int, level: int = 0) -> Iterator[Row]:
    """One row per distinct content, in memory of about ``budget`` bytes (or one content, if that is longer)."""
    table: dict[bytes, list] = {}
    held, spilled = 0, None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for h, content, keep_id, keep_rows, n in rows:
            if (entry := table.get(content)) is not None:
                _merged(entry, keep_id, keep_rows, n)
            elif not table or (spilled is None and held + len(content) + _ROW_OVERHEAD <= budget):
                table[content] = [h, keep_id, keep_rows, n]
                held += len(content) + _ROW_OVERHEAD
            else:
                if spilled is None:
                    spilled = [(Path(folder) / str(i)).open("w+b") for i in range(1 << FANOUT_BITS)]
                part = ((h & 0xFFFFFFFFFFFFFFFF) >> (FANOUT_BITS * (level % 15) + 4)) & ((1 << FANOUT_BITS) - 1)
                spilled[part].write(_HEAD.pack(h, keep_id or 0, keep_rows, n, keep_id is None) + struct.pack("<q", len(content)))
                spilled[part].write(content)
        for content, (h, keep_id, keep_rows, n) in table.items():
            yield h, content, keep_id, keep_rows, n
        table.clear()
        for file in spilled or ():
            file.seek(0)
            yield from grace_merge(_read_back(file), budget, level + 1)
            file.close()


def _read_back(file) -> Iterator[Row]:
    while head := file.read(_HEAD.size):
        h, keep_id, keep_rows, n, is_null = _HEAD.unpack(head)
        (length,) = struct.unpack("<q", file.read(8))
        yield h, file.read(length), None if is_null else keep_id, keep_rows, n


def _local_copies(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[Row]:
    """The copies inside one task merged, as far as a table of ``budget`` bytes reaches; then it starts afresh."""
    table: dict[bytes, list] = {}
    held = 0
    for batch in batches:
        for h, content, doc_id in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (entry := table.get(content)) is not None:
                _merged(entry, doc_id, 1, 1)
                continue
            if table and held + len(content) + _ROW_OVERHEAD > budget:
                yield from ((e[0], c, *e[1:]) for c, e in table.items())
                table, held = {}, 0
            table[content] = [h, doc_id, 1, 1]
            held += len(content) + _ROW_OVERHEAD
    yield from ((e[0], c, *e[1:]) for c, e in table.items())


def normalised(text: str = "text"):
    """The text whose equality counts: null is empty, each run of ASCII white space is one space."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def content_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 48 << 20) -> DataFrame:
    """Distinct contents: digest (SHA-256 of the normalised text), keep_id (smallest id), keep_rows (rows that carry
    it) and group_size. Ids are integers; a null id is larger than every other.
    """
    content = docs.select(normalised(text).alias("content"), F.col(f"`{doc_id}`").cast("long").alias("keep_id"))
    keyed = content.select(F.xxhash64("content").alias("hash"), F.col("content").cast("binary").alias("content"), "keep_id")

    def local(batches):
        yield from batches_of(_local_copies(batches, budget), _PARTIAL, 512)

    def buckets(batches):
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        merged = grace_merge(rows, budget)
        yield from batches_of(((hashlib.sha256(c).hexdigest(), k, m, n) for _, c, k, m, n in merged), _GROUPS)

    partial = keyed.mapInArrow(local, "hash long, content binary, keep_id long, keep_rows long, rows long")
    return partial.repartition("hash").mapInArrow(
        buckets, "digest string, keep_id long, keep_rows long, group_size long"
    )


def with_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 48 << 20) -> DataFrame:
    """Every row of ``docs`` with text_sha256, keep_id, group_size and kept.

    Null texts count as empty. An empty table gives an empty result. Rows that repeat both id and text are one
    document: all of them carry kept = true when their id stays (``drop_copies`` keeps one of them). Where no row of a
    group has an id, keep_id is null and its rows stay. Columns of ``docs`` with the new names are replaced.
    """
    digest, keep, size = fresh(docs, "digest_", "keep_id_", "group_size_")
    groups = content_groups(docs, doc_id, text, budget).select(
        F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("group_size").alias(size)
    )
    rows = docs.withColumn(digest, F.sha2(normalised(text), 256))
    new = {"keep_id": F.col(keep), "group_size": F.col(size), "kept": F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(keep)),
           "text_sha256": F.col(digest)}
    return rows.join(groups, digest).withColumns(new).drop(digest, keep, size)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id; all columns as they were."""
    digest, keep, rows = fresh(docs, "digest_", "keep_id_", "keep_rows_")
    groups = stored(content_groups(docs, doc_id, text, budget), "exact-groups")
    groups = groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("keep_rows").alias(rows))
    keyed = docs.withColumn(digest, F.sha2(normalised(text), 256))
    stays = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(keep))
    kept = keyed.join(groups, digest).filter(stays)
    if not groups.filter(F.col(rows) > 1).isEmpty():  # rows that repeat id and text: one stays
        kept = kept.filter(F.col(rows) == 1).unionByName(kept.filter(F.col(rows) > 1).dropDuplicates([digest]))
    return kept.drop(digest, keep, rows)
