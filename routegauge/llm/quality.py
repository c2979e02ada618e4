"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and signs of a text, and pairs of neighbours, fall into a fixed number of buckets. The raw model counts buckets over
all documents, the target model over documents labelled good. A document's weight is the log ratio of the two models,
averaged over its n-grams (so that length does not decide) and calibrated on labelled documents that neither model of
the target saw. Adding Gumbel noise to the calibrated log weights and taking the k largest draws k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import fresh, stored, text_or_empty
from routegauge.llm.labelled import bounded_labels, logistic
from routegauge.operators.ranking import with_rank

BUCKET_BITS = 14
LABELLED = 50_000  # documents per label that the target model and the calibration may use
BINS, BIN = 400, 0.02
BROADCAST_ROWS = 500_000
_UNIT = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Buckets:
    """Bucket numbers of a text's n-grams; hashes of words are kept while there is room."""

    def __init__(self, bits: int = BUCKET_BITS, room: int = 200_000):
        self.shift, self.room, self.known = np.uint64(64 - bits), room, {}

    def __call__(self, text: str) -> np.ndarray:
        units = _UNIT.findall(text.lower())
        known = self.known
        if len(known) > self.room:
            known.clear()
        hashes = []
        for unit in units:
            value = known.get(unit)
            if value is None:
                value = known[unit] = zlib.crc32(unit.encode("utf-8", "surrogatepass")) + 1
            hashes.append(value)
        one = np.array(hashes, dtype=np.uint64)
        with np.errstate(over="ignore"):
            two = (one[:-1] * np.uint64(0x100000001B3)) ^ (one[1:] + np.uint64(1 << 33))
            return (np.r_[one, two] * _MIX >> self.shift).astype(np.int64)


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of the good ones; ``docs`` has text and target (boolean)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, raw, target = Buckets(bits), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(buckets(text.as_py()), minlength=1 << bits)
                raw += found
                if good:
                    target += found
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"]
        )

    counted = docs.select("text", "target").mapInArrow(apply, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _log_ratio(counts: DataFrame, bits: int) -> np.ndarray:
    """Log ratio of target and raw probability per bucket; a target count is smoothed by the raw share of its bucket."""
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for bucket, r, t in counts.collect():  # as many rows as buckets
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(1 << bits)
    share = (raw + 0.5) / (raw + 0.5).sum()
    smooth = 50.0
    return np.log((target + smooth * share * len(share)) / (target.sum() + smooth * len(share))) - np.log(share)


def _ratios(docs: DataFrame, ratio: np.ndarray, bits: int) -> DataFrame:
    """(key, body, n_grams, ratio) of every row of key, body, text: the mean log ratio of its n-grams, 0 without any."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits)
        for batch in batches:
            found = [buckets(t.as_py()) for t in batch.column(2)]
            means = [float(ratio[b].mean()) if len(b) else 0.0 for b in found]
            sizes = [len(b) for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(means, pa.float64())],
                names=["key", "body", "n_grams", "ratio"],
            )

    return docs.mapInArrow(apply, "key long, body long, n_grams long, ratio double")


def importance(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    labelled: int = LABELLED, bits: int = BUCKET_BITS,
) -> DataFrame:
    """(key, body, n_grams, ratio, log_weight) of every row; key is its id, body a hash of its text.

    log_weight is the calibrated log odds that a document is good. Null texts count as empty; texts without n-grams have
    ratio 0. Without labels of both kinds among the calibration rows nothing tells documents apart: log_weight is 0.
    """
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("key"), text_or_empty(text).alias("text"))
    marked = F.broadcast(bounded_labels(labels, label, labelled).withColumn("held", F.pmod(F.xxhash64("label_id"), F.lit(5)) == 0))
    targets = marked.filter("label = 1 AND NOT held").select(F.col("label_id").alias("key"), F.lit(True).alias("target"))
    ratio = _log_ratio(_counted(keyed.join(F.broadcast(targets), "key", "left"), bits), bits)
    found = stored(_ratios(keyed.select("key", F.xxhash64("text").alias("body"), "text"), ratio, bits), "importance")
    bins = F.greatest(F.least(F.round(F.col("ratio") / BIN), F.lit(BINS)), F.lit(-BINS)).cast("int").alias("bin")
    seen = found.join(F.broadcast(marked.filter("held")), found["key"] == F.col("label_id")).groupBy(bins, "label").count().collect()
    a, b = 0.0, 0.0
    if len({r["label"] for r in seen}) == 2:
        a, b = logistic(np.array([[r["bin"] * BIN] for r in seen]), np.array([r["label"] for r in seen]), np.array([r["count"] for r in seen]))
    return found.withColumn("log_weight", F.lit(float(a)) * F.col("ratio") + F.lit(float(b)))


def gumbel_top(weights: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``weights`` with draw (log weight plus Gumbel noise of the row's own hash), place (1 is the largest) and selected."""
    slot = F.pmod(F.xxhash64("key", "body", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)
    noise = -F.log(-F.log(slot / F.lit(float(1 << 52))))
    drawn = weights.withColumn("draw", F.col("log_weight") + noise)
    ranked = with_rank(drawn, [F.desc("draw"), F.col("key"), F.col("body")], rank="place", size="of_rows")
    return ranked.drop("of_rows").withColumn("selected", F.col("place") <= k)


def expected_good(weights: DataFrame) -> int:
    """How many documents are good by their calibrated weights: the number with odds of one or more."""
    return weights.filter("log_weight >= 0").count()


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0, **options) -> DataFrame:
    """The rows of ``docs`` that the draw takes, as many as are expected to be good; all columns as they were.

    A row that the draw leaves out although its odds are above one stays: noise may add documents, never cost clean ones.
    """
    key, body, other = fresh(docs, "key_", "body_", "other_")
    weights = importance(docs, labels, doc_id, text, **options)
    drawn = gumbel_top(weights, expected_good(weights), seed)
    gone = drawn.filter(~F.col("selected") & (F.col("log_weight") < 0)).select(F.col("key").alias(key), F.col("body").alias(other))
    gone = stored(gone.distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.withColumn(body, F.xxhash64(text_or_empty(text)))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(key)) & (F.col(body) == F.col(other))
    return rows.join(gone, same, "left_anti").drop(body)
