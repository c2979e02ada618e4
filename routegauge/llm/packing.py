"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into pieces. Lengths are whole numbers up to the capacity, so their histogram is
bounded, and the whole packing is decided on it (``packing_plan``): large lengths are rounded up within groups of equal
cardinality, the configuration program over the few rounded lengths is solved, actual documents take the places of the
rounded ones, and small ones are best-fitted into what is left. Pieces find their place by their rank among
equal lengths; ranks are taken within salted slices of a length, so a length that a third of all documents share is no
single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge.llm.common import batches_of, fresh, stored, text_or_empty, worker_state
from routegauge.llm.packing_plan import make_plan
from routegauge.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of a document; all pieces are full but the first, which takes the remainder."""
    n = len(ids) // 4
    ends = range(n % capacity or capacity, n + 1, capacity) if n else ()
    start = 0
    for piece, end in enumerate(ends):
        yield piece, start, end - start, ids[4 * start : 4 * end]
        start = end


def tokenised(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row: ids are little-endian 32-bit token ids, ended by id 0.

    A null or empty text is the end id alone. Rows that repeat a doc_id are documents of their own.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_state(f"encoder:{tokenizer}", lambda: encoder(tokenizer))
        end = END_ID.to_bytes(4, "little")

        def rows():
            for batch in batches:
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for piece in cut(encode(body.as_py()).astype("<u4").tobytes() + end, capacity):
                        yield key, *piece

        yield from batches_of(rows(), _PIECES, 2048)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(apply, "doc_id long, piece int, start long, length long, ids binary")


def _ranked(pieces: DataFrame, length: str, order: list[Column], slices: int) -> tuple[DataFrame, dict[int, int]]:
    """Ranks from 0 among equal lengths, and the histogram of lengths."""
    salt, before, rank = fresh(pieces, "salt_", "before_", "rank_")
    dealt = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = stored(dealt.groupBy(length, salt).count(), "piece-counts")  # at most capacity x slices rows
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("count")).collect()}  # at most capacity rows
    earlier = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(length, salt, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy(length, salt).orderBy(*order)
    ranked = dealt.withColumn(rank, F.row_number().over(own) - 1).join(offsets, [length, salt])
    return ranked.withColumn(rank, F.col(rank) + F.col(before)).drop(salt, before), histogram


def place(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Every piece with sequence_id and offset. ``order`` names columns that tell pieces apart (equal rows may swap).

    Pieces share a sequence without gaps, from offset 0 on. Lengths must lie between 1 and ``capacity``. No pieces give
    no rows. Columns of ``pieces`` with the new names are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked, histogram = _ranked(pieces, length, [F.col(f"`{c}`") for c in order], slices)
    rank, names = ranked.columns[-1], pieces.columns
    runs = np.array(sorted(make_plan(histogram, capacity).runs), dtype=np.int64).reshape(-1, 5)
    keys = runs[:, 0] << 44 | runs[:, 1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(length).to_numpy(), batch.column(rank).to_numpy()
            run = runs[np.searchsorted(keys, lengths << 44 | ranks, "right") - 1]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(run[:, 2] + ranks - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(apply, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from placed pieces that carry ids."""
    parts = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))
