"""Ranking metrics on list columns. They work inside one row, so scoring needs no shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 64


def _discount(index: Column) -> Column:
    return F.log2(index.cast("double") + F.lit(2.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def top_k(pred: Column, k: int) -> Column:
    return F.slice(F.array_distinct(pred), 1, max(1, int(k)))


def binary_ndcg(pred: Column, truth: Column, k: int = 10) -> Column:
    """NULL for an empty prediction. The ideal list is as long as min(truth, kept prediction), not k."""
    kept, listed, truth = top_k(pred, k), truth, F.array_distinct(truth)
    gain = _sum(  # ``listed`` is not made distinct again for every entry
        F.transform(kept, lambda x, i: F.when(F.array_contains(listed, x), 1.0 / _discount(i)).otherwise(F.lit(0.0)))
    )
    ideal, acc = [], 0.0
    for i in range(max(1, int(k))):
        acc += 1.0 / math.log2(i + 2.0)
        ideal.append(F.lit(acc))
    best = F.element_at(F.array(*ideal), F.least(F.size(truth), F.size(kept)))
    return F.when(
        F.size(pred) > 0,
        F.when(F.size(truth) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), gain / best))),
    )


def recall(pred: Column, truth: Column, k: int = 10) -> Column:
    truth = F.array_distinct(truth)
    hits = F.size(F.array_intersect(top_k(pred, k), truth)).cast("double")
    return F.when(F.size(pred) > 0, F.when(F.size(truth) == 0, F.lit(0.0)).otherwise(hits / F.size(truth)))


def _both(pred: Column, truth: Column, value: Column) -> Column:
    return F.when((F.size(pred) > 0) & (F.size(truth) > 0), value).otherwise(F.lit(0.0))


def relevance(truth: Column, x: Column) -> Column:
    """len(truth) - rank, 0 when absent; a repeated id counts at its last position."""
    return F.array_position(F.reverse(truth), x)


def top1(pred: Column, truth: Column) -> Column:
    same = F.get(pred, F.lit(0)) == F.get(truth, F.lit(0))
    return _both(pred, truth, F.when(same, F.lit(1.0)).otherwise(F.lit(0.0)))


def concordant(ranks: np.ndarray) -> int:
    """Pairs in which the later entry is larger, counted bit by bit in n log n steps.

    Entries are kept in groups of equal higher bits, in their order; of a group, every entry with the next bit set follows
    on those before it without.
    """
    found, group = 0, np.zeros(len(ranks), np.int64)
    for bit in range(int(ranks.max()).bit_length() - 1, -1, -1) if len(ranks) else ():
        high = ranks >> bit & 1
        low_before = np.cumsum(1 - high)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        at_start = (low_before[first] - (1 - high[first])).repeat(np.diff(np.r_[first, len(group)]))
        found += int((low_before - at_start)[high == 1].sum())
        group = group * 2 + high
        order = np.argsort(group, kind="stable")
        ranks, group = ranks[order], group[order]
    return found


@F.arrow_udf(T.DoubleType())
def _long_accuracy(pred: pa.Array, truth: pa.Array) -> pa.Array:
    out = []
    for own, known in zip(pred, truth, strict=True):
        if not own.is_valid or not known.is_valid:
            out.append(None)
            continue
        places = {x: p for p, x in enumerate(known.as_py()) if x is not None}  # the last place of a repeated id
        ranks = np.array([places[x] for x in own.as_py() if x in places], np.int64)
        m = len(ranks)
        out.append(concordant(ranks) / (m * (m - 1) / 2) if m > 1 else 0.0)
    return pa.array(out, pa.float64())


def pairwise_accuracy(pred: Column, truth: Column) -> Column:
    """Share of concordant pairs among the ids both lists know; 0 with fewer than two.

    Lists of up to ``SHORT`` ids are compared pair by pair inside Spark, longer ones are counted in n log n steps.
    """
    ranks = F.filter(F.transform(pred, lambda x: -relevance(truth, x)), lambda r: r < 0)
    m = F.size(ranks)
    right = F.aggregate(
        F.transform(ranks, lambda a, i: F.size(F.filter(F.slice(ranks, i + 2, F.greatest(m, F.lit(1))), lambda b: b > a))),
        F.lit(0).cast("bigint"),
        lambda s, n: s + n,
    )
    pairs = m.cast("bigint") * (m - 1) / 2
    short = F.when(m > 1, right / pairs).otherwise(F.lit(0.0))
    long = F.greatest(F.size(pred), F.size(truth)) > SHORT
    counted = _long_accuracy(F.when(long, pred), F.when(long, truth))
    return _both(pred, truth, F.when(long, counted).otherwise(short))


def footrule(pred: Column, truth: Column) -> Column:
    """1 - F / floor(m*m/2) on full-list ranks of the common ids; negative values are possible."""
    placed = F.filter(
        F.transform(pred, lambda x, i: F.struct(i.alias("p"), relevance(truth, x).alias("rel"))), lambda s: s["rel"] > 0
    )
    m = F.size(placed)
    moved = _sum(F.transform(placed, lambda s: F.abs(s["p"] - (F.size(truth) - s["rel"])).cast("double")))
    worst = F.floor(m * m / 2)
    value = F.when(m == 0, F.lit(0.0)).when(worst == 0, F.lit(1.0)).otherwise(1.0 - moved / worst)
    return _both(pred, truth, value)


def graded_ndcg(pred: Column, truth: Column, k: int | None = None, exponential: bool = False) -> Column:
    """NDCG with relevance len(truth) - rank; k of None or below 1 means the whole prediction."""
    cut = F.size(pred) if k is None or k <= 0 else F.lit(int(k))

    def gain(rel: Column, i: Column) -> Column:
        value = F.pow(F.lit(2.0), rel.cast("double")) - 1.0 if exponential else rel.cast("double")
        return value / _discount(i)

    got = _sum(F.transform(F.slice(pred, F.lit(1), cut), lambda x, i: gain(relevance(truth, x), i)))
    ideal = F.sort_array(F.transform(truth, lambda x: relevance(truth, x)), asc=False)
    best = _sum(F.transform(F.slice(ideal, F.lit(1), cut), lambda rel, i: gain(rel, i)))
    return _both(pred, truth, F.when(best > 0, got / best).otherwise(F.lit(0.0)))
