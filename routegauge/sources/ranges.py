"""Byte ranges of files, so that one large file is read by many tasks; Spark lists the files, tasks read their ranges."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.session import ship_package

RANGE_BYTES = 64 << 20
TASK_BYTES = 64 << 20  # bytes of small ranges that one task reads
TASKS_PER_CORE = 4
_QUOTE, _SLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


def opened(file: str) -> pa.NativeFile:
    """A file that Spark has listed, for reading at any place."""
    if file.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote(file.removeprefix("file:").replace("//", "", 1) if file.startswith("file://") else file[5:]))
    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size) of the files under a path; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"))


def spread(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """Rows over tasks: one a row as far as there are tasks to keep all cores busy, and more only by the bytes that rows stand for.

    A table of many small files or ranges so takes as many tasks as its bytes need, each reading one row after the other.
    """
    n, held = rows.agg(F.count(F.lit(1)), F.sum(F.lit(0) if size is None else size)).first()
    busy = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(min(n, max(busy, -(-(held or 0) // TASK_BYTES))), 1), *rows.columns)


def file_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(file, no, start, stop): consecutive ranges of every file."""
    last = F.greatest(F.floor((F.col("size") - 1) / size), F.lit(0))
    cut = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("no"))
    return cut.select("file", "no", (F.col("no") * size).alias("start"), F.least((F.col("no") + 1) * size, F.col("size")).alias("stop"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


# --- one JSON array per file ------------------------------------------------------------------------


def first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, head) with the first byte of every file that is no white space."""
    for row in _rows(batches):
        with opened(row["file"]) as source:
            head = b""
            while not head and (part := source.read(1 << 12)):
                head = part.lstrip(b" \t\r\n\xef\xbb\xbf")
        yield pa.RecordBatch.from_pydict({"file": [row["file"]], "head": [head[:1].decode("latin-1")]})


def array_files(files: DataFrame) -> DataFrame:
    """Those files (file, size) that hold one JSON array."""
    ship_package(files.sparkSession)
    heads = files.select("file").mapInArrow(first_bytes, "file string, head string").filter("head = '['").select("file")
    return files.join(heads, "file", "left_semi")


def marks(data: bytes, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(places, steps) of the brackets outside strings, and whether the end is inside a string, and behind a backslash.

    ``escaped`` and ``inside`` say the same of the start.
    """
    codes = np.frombuffer(data, np.uint8)
    slash = np.flatnonzero(codes == _SLASH)
    run_start = np.flatnonzero(np.r_[True, np.diff(slash) > 1]) if len(slash) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[run_start, len(slash)])
    firsts = slash[run_start]
    lengths = lengths + ((firsts == 0) & escaped)
    ends = firsts + np.diff(np.r_[run_start, len(slash)])
    loose = set(ends[lengths % 2 == 1].tolist())  # bytes behind an odd run of backslashes
    if escaped and not (len(slash) and firsts[0] == 0):
        loose.add(0)
    quotes = np.flatnonzero(codes == _QUOTE)
    quotes = quotes[~np.isin(quotes, list(loose))] if loose else quotes
    steps = _STEP[codes]
    places = np.flatnonzero(steps)
    places = places[~np.isin(places, list(loose))] if loose else places
    within = (np.searchsorted(quotes, places) + inside) % 2 == 1
    places = places[~within]
    return places, steps[places], bool((len(quotes) + inside) % 2), len(codes) in loose


def _trailing(source: pa.NativeFile, start: int) -> bool:
    """Whether the bytes before a place end in an odd number of backslashes."""
    count = 0
    while start > 0:
        source.seek(max(start - 64, 0))
        part = source.read(start - max(start - 64, 0))
        kept = part.rstrip(b"\\")
        count += len(part) - len(kept)
        if kept:
            break
        start -= len(part)
    return count % 2 == 1


_PASSED = "file string, no long, inside boolean, ends_inside boolean, depth long, records array<long>"


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For either state at the start of a range: its state at the end, the change of depth, and the brackets that open at
    every depth relative to the start (from the lowest), so that records can be counted once the depth is known."""
    for row in _rows(batches):
        with opened(row["file"]) as source:
            escaped = _trailing(source, row["start"])
            source.seek(row["start"])
            data = source.read(row["stop"] - row["start"])
        out = []
        for inside in (False, True):
            _, steps, ends, _ = marks(data, escaped, inside)
            depth = np.cumsum(steps)
            opening = depth[steps > 0]
            values, counts = np.unique(opening, return_counts=True)
            pairs = [int(x) for pair in zip(values, counts, strict=True) for x in pair][:4096]
            out.append((row["file"], row["no"], inside, ends, int(depth[-1]) if len(depth) else 0, pairs))
        columns = zip(*out, strict=True)
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                         names=["file", "no", "inside", "ends_inside", "depth", "records"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, index, value) of the records that start in a range; the last one is read on to its end."""
    for row in _rows(batches):
        with opened(row["file"]) as source:
            escaped = _trailing(source, row["start"])
            source.seek(row["start"])
            data = source.read(row["stop"] - row["start"])
            places, steps, inside, loose = marks(data, escaped, row["inside"])
            depth = row["depth"] + np.cumsum(steps)
            starts = places[(steps > 0) & (depth == 2)]
            ends = places[(steps < 0) & (depth == 1)]
            ends = ends[ends > starts[0]] if len(starts) else ends[:0]
            while len(starts) > len(ends):  # the last record goes on behind the range
                more = source.read(1 << 16)
                if not more:
                    raise ValueError(f"{row['file']} ends within a record")
                places, steps, inside, loose = marks(more, loose, inside)
                after = (int(depth[-1]) if len(depth) else row["depth"]) + np.cumsum(steps)
                found = places[(steps < 0) & (after == 1)][:1] + len(data)
                ends, data, depth = np.r_[ends, found], data + more, after if len(after) else depth
        for at in range(0, len(starts), 256):
            values = [data[a : b + 1].decode("utf-8") for a, b in zip(starts[at : at + 256], ends[at : at + 256], strict=True)]
            index = row["before"] + at + np.arange(len(values))
            yield pa.RecordBatch.from_pydict({"file": [row["file"]] * len(values), "index": pa.array(index, pa.int64()), "value": values})


def array_records(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(file, index, value): the records (objects or arrays) of files that hold one JSON array each, as JSON texts.

    Ranges are passed twice. First every task tells how its range changes the state of the reader, whether it starts inside a
    string or not; the driver, which sees one row per range, hands the states on. Then every task cuts out the records that
    start in its range.
    """
    spark = files.sparkSession
    ship_package(spark)
    ranges = file_ranges(files, size).cache()
    held = F.col("stop") - F.col("start")
    passed = spread(ranges, held).mapInArrow(_passed, _PASSED).collect()
    known = {(r["file"], r["no"], r["inside"]): r for r in passed}
    states = []
    for file in sorted({r["file"] for r in passed}):
        inside, depth, before, no = False, 0, 0, 0
        while (r := known.get((file, no, inside))) is not None:
            states.append((file, no, inside, depth, before))
            pairs = dict(zip(r["records"][::2], r["records"][1::2], strict=True))
            before += pairs.get(2 - depth, 0)
            inside, depth, no = r["ends_inside"], depth + r["depth"], no + 1
    found = spark.createDataFrame(states, "file string, no long, inside boolean, depth long, before long")
    return spread(ranges.join(found, ["file", "no"]), held).mapInArrow(_records, "file string, index long, value string")
