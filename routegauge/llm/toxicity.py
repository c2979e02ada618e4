"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary documents, back off to counts that they share: pairs of neighbours
to the pairs of both classes together, words to the number of documents of the whole corpus that a word occurs in (its
contexts, as Kneser-Ney counts them). So a rare expression that only one class shows gets nearly the same probability
from both models, and only what one class shows again and again tells them apart. A text is scored by its log-likelihood ratio per word, over the whole
text and over its most toxic expression (a run of a few neighbouring words); a logistic fit on labelled
documents that the models did not see turns the two into a probability.

The class counts come from at most ``labelled`` documents per label, so both models stay small enough to be sent to every
task. The shared counts cover all documents; only those of words in the class models are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import stored, text_or_empty
from routegauge.llm.labelled import bounded_labels, logistic

LABELLED = 2_000  # documents per label for the class counts, and again as many for the calibration
EXPRESSION = 1  # words
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Log-likelihood ratios of toxic and ordinary bigram models over numbered words; number 0 stands for all others."""

    words: dict[str, int]
    single: np.ndarray  # P(word | class), two rows
    keys: np.ndarray  # left << 32 | right of the bigrams that some class has, sorted
    direct: np.ndarray  # discounted share of those bigrams behind their left word, two rows
    pooled: np.ndarray  # share of those bigrams behind their left word in both classes together
    backoff: np.ndarray  # weight of the lower orders behind a left word, two rows
    seen: np.ndarray  # whether some class has the left word

    def ratios(self, text: str) -> np.ndarray:
        """Per word: log P(word | the word before, toxic) minus the same for ordinary."""
        get = self.words.get
        ids = np.array([get(w, 0) for w in _WORD.findall(text.lower())], dtype=np.int64)
        if not len(ids) or not len(self.keys):
            return np.zeros(len(ids))
        left = np.r_[0, ids[:-1]]
        key = left << 32 | ids
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = self.keys[at] == key
        shared = np.where(met, self.pooled[at], 0.0)
        lower = np.where(self.seen[left], 0.5 * self.single[:, ids] + 0.5 * shared, self.single[:, ids])
        p = np.where(met, self.direct[:, at], 0.0) + self.backoff[:, left] * lower
        return np.log(p[0]) - np.log(p[1])

    def features(self, text: str) -> tuple[float, float]:
        """Mean ratio of the text, and of its most toxic expression; zeros without words."""
        r = self.ratios(text)
        if not len(r):
            return 0.0, 0.0
        total = np.r_[0, np.cumsum(r)]
        width = min(EXPRESSION, len(r))
        return float(r.mean()), float((total[width:] - total[:-width]).max() / width)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney: the amount taken off counts of 1, 2 and more, from how many entries have which count."""
    n = [max(float((counts == i).sum()), 1.0) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *[np.clip(i - (i + 1) * y * n[i] / n[i - 1], 0.1, i - 0.05) for i in (1, 2, 3)]])


def _taken(counts: np.ndarray) -> np.ndarray:
    """What the lower order gets of each count: the discount, and no less than twice the count's standard error.

    Near copies raise counts of rare expressions together; the second part keeps such small counts from deciding.
    """
    return np.minimum(np.maximum(_discounts(counts)[np.minimum(counts, 3)], 2 * np.sqrt(counts)), counts)


def build(bigrams: pa.Table, spread: pa.Table, documents: int) -> Model:
    """The model of bigrams (l, r, toxic, ordinary: document counts) and of the shared document counts of words.

    The left word of a text's first word is ''. Unknown words have a document count of one, spread over none. The words
    stay in Arrow arrays until the one dictionary that the model looks them up in.
    """
    known_words = pc.unique(bigrams["r"])
    n = len(known_words) + 1

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        return pc.add(pc.fill_null(pc.index_in(column, value_set=known_words), -1), 1).to_numpy().astype(np.int64)

    shared = np.ones(n)
    shared[numbers(spread["word"])] += spread["documents"].to_numpy()
    shared[0] = 1.0
    shared /= shared.sum() + documents  # what is left belongs to unknown words
    key = numbers(bigrams["l"]) << 32 | numbers(bigrams["r"])
    order = np.argsort(key)
    key = key[order]
    counts = [bigrams[c].to_numpy().astype(np.int64)[order] for c in ("toxic", "ordinary")]
    words = {w: i + 1 for i, w in enumerate(known_words.to_pylist())}
    single, direct, backoff = np.zeros((2, n)), np.zeros((2, len(key))), np.ones((2, n))
    for c in range(2):
        count = counts[c]
        total = np.bincount(key & 0xFFFFFFFF, weights=count, minlength=n).astype(np.int64)
        taken = np.where(total > 0, _taken(total), 0)
        mass = max(total.sum(), 1)
        single[c] = (total - taken) / mass + max(taken.sum() / mass, 1e-3) * shared
        after = np.bincount(key >> 32, weights=count, minlength=n)
        off = np.where(count > 0, _taken(count), 0)
        known = after > 0
        safe = np.where(known, after, 1)
        backoff[c] = np.where(known, np.bincount(key >> 32, weights=off, minlength=n) / safe, 1.0)
        direct[c] = (count - off) / safe[key >> 32]
    both = (counts[0] + counts[1]).astype(np.float64)
    behind = np.bincount(key >> 32, weights=both, minlength=n)
    pooled, seen = both / behind[key >> 32], behind > 0
    backoff[:, 0], direct[:, key >> 32 == 0], seen[0] = 1.0, 0.0, False  # behind unknown words both classes back off
    return Model(words, single, key, direct, pooled, backoff, seen)


def _bigrams(rows: DataFrame) -> DataFrame:
    """(left, right, toxic, ordinary): in how many labelled documents a pair of neighbours occurs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights, labels = [], [], []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = _WORD.findall(text.as_py().lower())
                pairs = set(zip(["", *found[:-1]], found, strict=True))
                lefts += [p[0] for p in pairs]
                rights += [p[1] for p in pairs]
                labels += [label] * len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string()), pa.array(labels, pa.int32())],
                                             names=["l", "r", "label"])

    pairs = rows.select("text", "label").mapInArrow(apply, "l string, r string, label int")
    return pairs.groupBy("l", "r").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("ordinary")
    )


def _spread(docs: DataFrame) -> DataFrame:
    """(word, documents): in how many documents a word occurs, over the whole corpus."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for word in set(_WORD.findall(text.as_py().lower())):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > 300_000:  # hand on what has been counted and go on
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return docs.select("text").mapInArrow(apply, "word string, n long").groupBy("word").agg(F.sum("n").alias("documents"))


def _counted(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    learn: Column | None = None, labelled: int = LABELLED,
) -> DataFrame:
    """(doc_id, ratio, expression, score) of every row: the two log-likelihood ratios per word, and the probability.

    ``learn`` is a condition on label_id that a label must meet to be learnt from. Null texts count as empty; texts without words
    have ratios of 0. Without labels of both kinds every score is 0. Rows that repeat get the same answer each.
    """
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    fold = F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(2))
    marked = bounded_labels(labels, label, 2 * labelled, where=learn).withColumn("fold", fold)
    sample = stored(keyed.join(F.broadcast(marked), keyed["doc_id"] == marked["label_id"]).select("text", "label", "fold").dropDuplicates(["text"]), "toxic-sample")
    pairs = stored(_bigrams(sample.filter("fold = 0")), "toxic-pairs")  # as many as the bounded sample holds
    vocabulary = pairs.select(F.col("r").alias("word")).distinct()
    spread = _spread(keyed).join(vocabulary, "word").toArrow()
    model = build(pairs.toArrow(), spread, pc.max(spread["documents"]).as_py() or 1)
    fitted = len(model.keys) > 0
    sent = docs.sparkSession.sparkContext.broadcast(model)
    del model, spread

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [sent.value.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64())],
                names=["doc_id", "ratio", "expression"],
            )

    schema = "doc_id long, ratio double, expression double"
    unseen = sample.filter("fold = 1").select(F.col("label").cast("long").alias("doc_id"), "text").mapInArrow(apply, schema).collect()
    theta = None
    if len({r["doc_id"] for r in unseen}) == 2 and fitted:
        wanted = np.array([r["doc_id"] for r in unseen])
        share = wanted.mean()  # both labels weigh the same
        theta = logistic(np.array([[r["ratio"], r["expression"]] for r in unseen]), wanted, np.where(wanted == 1, 0.5 / share, 0.5 / (1 - share)))
    scored = keyed.mapInArrow(apply, schema)
    if theta is None:
        return scored.withColumn("score", F.lit(0.0))
    z = F.lit(float(theta[0])) * F.col("ratio") + F.lit(float(theta[1])) * F.col("expression") + F.lit(float(theta[2]))
    return scored.withColumn("score", 1 / (1 + F.exp(-z)))
