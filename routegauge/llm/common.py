"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.session import cut_lineage, ensure_checkpoint_dir, read_table

__all__ = ["Kept", "batches_of", "cut_lineage", "fresh", "let", "lower_ascii", "read_table", "slices", "stored", "text_or_empty", "worker_state"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that do not clash with a column of ``df`` (column names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that where a text has one byte per character, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder of ``spark.checkpoint.dir`` and read it back: it outlives executors."""
    spark: SparkSession = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows out of a stream of tuples."""
    rows = iter(rows)
    while chunk := list(islice(rows, size)):
        columns = zip(*chunk, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def slices(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size``, for functions whose output is larger than their input."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, so that later tasks find it again."""
    held = sys.__dict__.setdefault("_routegauge_worker_state", {})
    if name not in held:
        held[name] = make()
    return held[name]


class Kept(dict):
    """A cache of two generations: when the young one is full it takes the place of the old one, whose used entries come back."""

    def __init__(self, entries: int):
        super().__init__()
        self.half, self.old = max(entries // 2, 1), {}

    def recall(self, key):
        value = self.old.get(key)
        if value is not None:
            self.enter(key, value)
        return value

    def enter(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
