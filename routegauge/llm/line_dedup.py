"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``most`` edits share one of ``most + 1`` segments, at nearly the same place. Every line is indexed under
its segments and looks up its own substrings among lines up to ``most`` characters shorter (``edit_distance.probes``). Only
hashes of segments are dealt out at first: an index of one row per segment tells which look-ups meet another line, in a
join that can be split where a segment is common. Lines that met another one are fetched and compared. Buckets of a common
segment are dealt out in blocks of residents. A task returns a spanning forest of the links it has verified, and pairs that
are linked already are not compared again, so thousands of variants of one line cost no square.

Texts are split into lines once; the table of lines holds every line's text at least once, and mostly once per task. Lines
are known by 64-bit hashes of their normalised text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import fresh, slices, stored, text_or_empty
from routegauge.llm.components import components
from routegauge.llm.edit_distance import probes, segments, within
from routegauge.session import ship_package

MOST = 2
SHARE = 0.2  # edits a line may have per character
RESIDENTS = 2048
BROADCAST_ROWS = 1_000_000
SEED = 42
_SIGNS = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lines_of(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, signed hash, line) of the non-empty lines of a UTF-8 text: ASCII white space made one space, ends trimmed."""
    for no, raw in enumerate(text.split(b"\n")):
        if line := b" ".join(raw.split()):
            h = xxhash.xxh64_intdigest(line, SEED)
            yield no, h - (1 << 64) if h >> 63 else h, line


def allowed(shorter: int, most: int = MOST, share: float = SHARE) -> int:
    """How many edits two lines may differ by, given the length of the shorter one."""
    return min(most, int(share * shorter))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash, and of its inverse."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


@lru_cache(5000)
def _plan(length: int, most: int, home: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, start, end) of the segments of a line of this length, or of its look-ups among other lines."""
    own = [(length * 8 + i, at, at + size) for i, (at, size) in enumerate(segments(length, most))]
    if not home:
        own = [x for x in ((other * 8 + i, at, at + size) for other, i, at, size in probes(length, most)) if x not in own]
    seeds, starts, ends = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else [np.zeros(0, np.int64)] * 3
    return seeds.astype(np.uint64) * _SIGNS, starts, ends


def substring_keys(lines: list[str], most: int, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the line) of the segments of lines (``home``), or of the substrings to look up.

    All substrings of a batch come from the prefix sums of one rolling hash. It only proposes: lines are compared later.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    starts, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        n = int(lengths[rows[0]]) if len(rows) else 0
        if n <= most or allowed(n + most, most) == 0:
            continue
        seeds, a, b = _plan(n, most, home)
        left, right = starts[rows][:, None] + a, starts[rows][:, None] + b
        hashes = (sums[right] - sums[left]) * down[left] ^ seeds
        hashes = (hashes ^ hashes >> np.uint64(32)) * _SIGNS
        keys.append((hashes ^ hashes >> np.uint64(29)).ravel())
        owners.append(np.repeat(rows, len(a)))
    return np.concatenate(keys), np.concatenate(owners)


def _parts(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """(hashes, lines) of a batch, about ``chars`` characters at a time."""
    ids, lines, held = [], [], 0
    for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(h)
        lines.append(line)
        held += len(line)
        if held >= chars:
            yield ids, lines
            ids, lines, held = [], [], 0
    if lines:
        yield ids, lines


def _keys(most: int, home: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lines in _parts(batch):
                keys, owners = substring_keys(lines, most, home)
                for at in range(0, len(keys), 1 << 18):
                    some = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[some].view(np.int64)), pa.array(np.array(ids, np.int64)[owners[some]])], names=["k", "h"]
                    )

    return apply


def _sign(line: str) -> int:
    """64 bits over pairs of neighbouring characters; an edit changes four of them at most."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        bits = (codes[:-1] * np.uint64(31) + codes[1:]) * _SIGNS >> np.uint64(58)
    return int(np.bitwise_or.reduce(np.uint64(1) << bits)) if len(bits) else 0


def _verify(most: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        links: list[tuple[int, int]] = []
        key, ids, texts, signs, sizes = None, [], [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for k, h, home, line in rows:
                if k != key:
                    key, ids, texts, signs, sizes = k, [], [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                sign = np.uint64(_sign(line))
                close = (np.bitwise_count(signs ^ sign) <= 4 * most) & (np.abs(sizes - len(line)) <= most)
                for i in np.flatnonzero(close).tolist():
                    a, b = find(h), find(ids[i])
                    if a != b and within(line, texts[i], allowed(min(len(line), len(texts[i])), most)):
                        parent[max(a, b)] = min(a, b)
                        links.append((h, ids[i]))
                if home:
                    ids.append(h)
                    texts.append(line)
                    signs, sizes = np.r_[signs, sign], np.r_[sizes, len(line)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], names=["a", "b"])
                links = []

    return apply


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in slices(batches):
        keys, bodies, numbers, hashes, lines = [], [], [], [], []
        for key, body, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for no, h, line in lines_of(text.as_py()):
                keys.append(key)
                bodies.append(body)
                numbers.append(no)
                hashes.append(h)
                lines.append(None if h in seen else line.decode("utf-8", "replace"))
                seen.add(h)
        if len(seen) > 200_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(bodies, pa.int64()), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()),
             pa.array(lines, pa.string())],
            names=["key", "body", "no", "h", "line"],
        )


def split_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body, no, h, line) of every non-empty line; line is null where the same task has given the text before."""
    ship_package(docs.sparkSession)
    body = text_or_empty(text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("key"), F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))
    return stored(rows.mapInArrow(_split, "key long, body long, no int, h long, line string"), "lines")


def line_links(lines: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between distinct lines (h, line), known by their hashes."""
    homes = stored(lines.mapInArrow(_keys(most, True), "k long, h long"), "home-segments")
    visits = lines.mapInArrow(_keys(most, False), "k long, h long")
    index = homes.groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))  # one row per segment
    met = visits.join(index, "k").filter("low <> h OR high <> h").select("k", "h")
    met = stored(met, "met-segments")
    busy = index.filter("low <> high").select("k").union(met.select("k")).distinct()
    live = homes.join(busy, "k", "left_semi").distinct().withColumn("home", F.lit(True)).unionByName(
        met.distinct().withColumn("home", F.lit(False))
    )
    live = stored(live, "live-segments")
    wanted = live.select("h").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = lines.join(wanted, "h", "left_semi").dropDuplicates(["h"])
    hot = live.filter("home").groupBy("k").count().filter(F.col("count") > RESIDENTS)
    hot = hot.select("k", F.ceil(F.col("count") / RESIDENTS).cast("int").alias("blocks"))
    dealt = live.join(hot, "k", "left")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    own = F.pmod(F.xxhash64("h"), F.coalesce("blocks", F.lit(1))).cast("int")
    # a resident stays in its own block and visits the others, as every visitor does
    dealt = dealt.select("k", "h", F.explode(every).alias("block"), (F.col("home")).alias("resident"), own.alias("own"))
    dealt = dealt.select(F.xxhash64("k", "block").alias("k"), "h", (F.col("resident") & (F.col("block") == F.col("own"))).alias("home"))
    met = dealt.join(texts, "h").select("k", "h", "home", "line")
    return met.repartition("k").sortWithinPartitions("k", F.desc("home")).mapInArrow(_verify(most), "a long, b long").distinct()


def marked_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(key, body, no, h, root, head, variants, repeats) of every non-empty line; repeats: an earlier line is linked to it.

    Lines come in the order of (doc_id, line number), null ids first; the first of every class stays and is its head (key,
    no, body). key is the id of the document, body a hash of its text, root the class, variants the number of different
    lines in it (root, head and variants are null for a line that nothing repeats). Lines are linked if equal, or within
    ``most`` edits and a fifth of the shorter length.
    """
    rows = split_lines(docs, doc_id, text)
    roots = stored(components(line_links(rows.filter("line IS NOT NULL").select("h", "line"), most)), "line-roots")
    place = F.struct("key", "no", "body")
    distinct = rows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classed = distinct.join(roots.withColumnRenamed("node", "h"), "h", "left").filter("n > 1 OR root IS NOT NULL")
    classed = stored(classed.select("h", "first", F.coalesce("root", "h").alias("root")), "line-classes")
    heads = classed.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("variants"))
    info = classed.join(heads, "root").select("h", "root", "head", "variants")
    return rows.drop("line").join(info, "h", "left").select(
        "key", "body", "no", "h", "root", "head", "variants", (F.col("root").isNotNull() & ~place.eqNullSafe(F.col("head"))).alias("repeats")
    )


def with_line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """Every row of ``docs`` with n_lines (non-empty lines), dropped (sorted numbers of lines that repeat an earlier one) and
    repeats: for each of these its number, its class, the document and number of the line that stays, and the variants.

    Null and empty texts have no lines; an empty table gives no rows. Texts and lines are read whole, however long. Rows that
    repeat id and text are one document and get the same answer each. Columns of ``docs`` with the new names are replaced.
    """
    key, body, own, n, found_repeats = fresh(docs, "line_key_", "line_body_", "own_body_", "n_lines_", "repeats_")
    repeat = F.struct("no", F.col("root").alias("class"), F.col("head.key").alias("head_id"), F.col("head.no").alias("head_no"), "variants")
    found = marked_lines(docs, doc_id, text, most).groupBy("key", "body").agg(
        F.count_distinct("no").alias(n), F.array_sort(F.collect_set(F.when(F.col("repeats"), repeat))).alias(found_repeats)
    )
    found = stored(found, "line-report").withColumnsRenamed({"key": key, "body": body})
    rows = docs.withColumn(own, F.xxhash64(text_or_empty(text)))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(body))
    none = F.array().cast(dict(found.dtypes)[found_repeats])
    joined = rows.join(found, same, "left").withColumns({"n_lines": F.coalesce(n, F.lit(0)).cast("long"), "repeats": F.coalesce(found_repeats, none)})
    return joined.withColumn("dropped", F.transform("repeats", lambda x: x["no"])).drop(key, body, own, n, found_repeats)


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts; other lines stay as they were. Columns as they were."""
    own, gone = fresh(docs, "text_", "gone_")
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = with_line_report(plain, "id", "text", most).filter(F.size("dropped") > 0)
    found = found.select(F.col("id").alias(own), F.xxhash64(text_or_empty("text")).alias(gone), "dropped").dropDuplicates([own, gone])
    hashed, dropped = fresh(docs.withColumns({own: F.lit(0), gone: F.lit(0)}), "hash_", "dropped_")
    rows = docs.withColumn(hashed, F.xxhash64(text_or_empty(text))).join(
        found.withColumnRenamed("dropped", dropped), F.col(f"`{doc_id}`").eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(gone)), "left"
    )
    kept = F.filter(F.split(text_or_empty(text), "\n"), lambda x, i: ~F.array_contains(dropped, i))
    return rows.withColumn(text, F.when(F.col(dropped).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])
