"""Sinks for entries, metrics, curves and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from routegauge.session import ship_package


def write_entries(entries: DataFrame, path: str, shard_size: int = 10_000, fmt: str = "parquet") -> None:
    """One row per entry vector, at most ``shard_size`` rows per file."""
    entries.write.mode("errorifexists").option("maxRecordsPerFile", shard_size).format(fmt).save(path)


def write_chats(chats: DataFrame, path: str) -> None:
    """One chat per JSON line (column ``chat``)."""
    chats.write.mode("errorifexists").json(path)


def write_table(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Metrics, curves and summaries; CSV gets a header line."""
    writer = table.write.mode("errorifexists").format(fmt)
    (writer.options(header=True, escape='"') if fmt == "csv" else writer).save(path)


def write_json_arrays(records: DataFrame, path: str) -> None:
    """JSON texts (column ``value``) as one JSON array per file, a record on each line."""
    ship_package(records.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [before + lines[0], *["," + x for x in lines[1:]]]})
                before = ","
        yield pa.RecordBatch.from_pydict({"value": ["]" if before == "," else "[]"]})

    records.select("value").mapInArrow(apply, "value string").write.mode("errorifexists").text(path)
