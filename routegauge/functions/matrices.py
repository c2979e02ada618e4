"""Arrow functions on small blocks of vectors. Spark bounds, partitions and merges the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLUSTERS = 3
RECENT = 3
SMALL = 1 << 10  # most distances of two blocks that are taken at once
EPS = 1e-12
_DOUBLE, _DOUBLES, _INTS = T.DoubleType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
_PRODUCTS = T.StructType([
    T.StructField("cnt", T.LongType()), T.StructField("total", _DOUBLE),
    T.StructField("squares", _DOUBLE), T.StructField("low", _DOUBLE),
])
_PARTS = T.ArrayType(T.StructType([
    T.StructField("part", T.StringType()), T.StructField("n", T.LongType()), T.StructField("squares", _DOUBLE),
    T.StructField("cells", _DOUBLE), T.StructField("vsum", _DOUBLES), T.StructField("usum", _DOUBLES),
]))
_NEAR = T.ArrayType(T.StructType([T.StructField(c, _DOUBLE) for c in ("sim", "recent", "dist")]))
_DOUBLES_ARROW = pa.list_(pa.float64())
_PARTS_ARROW = pa.list_(pa.struct([
    ("part", pa.string()), ("n", pa.int64()), ("squares", pa.float64()), ("cells", pa.float64()),
    ("vsum", _DOUBLES_ARROW), ("usum", _DOUBLES_ARROW),
]))
_FARTHEST = T.StructType([T.StructField("gap", _DOUBLE), T.StructField("v", _DOUBLES)])
_FARTHEST_ARROW = pa.struct([("gap", pa.float64()), ("v", _DOUBLES_ARROW)])
_SUMS = T.ArrayType(T.StructType([
    T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", _DOUBLES),
]))
_SUMS_ARROW = pa.list_(pa.struct([("label", pa.int32()), ("n", pa.int64()), ("total", _DOUBLES_ARROW)]))
_NEAR_ARROW = pa.list_(pa.struct([(c, pa.float64()) for c in ("sim", "recent", "dist")]))


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's array<array<double>> as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    outer = column.offsets.to_numpy()
    inner = column.values
    inner_offsets = inner.offsets.to_numpy()
    flat = inner.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        lo, hi = outer[i], outer[i + 1]
        rows = hi - lo
        start, stop = inner_offsets[lo], inner_offsets[hi]
        yield flat[start:stop].reshape(rows, -1).astype(np.float64) if rows else np.zeros((0, 0))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + EPS)


@F.arrow_udf(_DOUBLE)
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Row-wise cosine of two vector columns without nulls."""
    return pa.array((_unit(_vectors(left)) * _unit(_vectors(right))).sum(axis=-1), pa.float64())


@F.arrow_udf(_DOUBLE)
def dot(left: pa.Array, right: pa.Array) -> pa.Array:
    """Row-wise dot product of two vector columns without nulls."""
    return pa.array((_vectors(left) * _vectors(right)).sum(axis=-1), pa.float64())


@F.arrow_udf(_DOUBLES)
def vector_total(block: pa.Array) -> pa.Array:
    """Element-wise sum of the vectors of a block."""
    return pa.array([x.sum(axis=0) for x in _blocks(block)], _DOUBLES_ARROW)


@F.arrow_udf(_PARTS)
def block_parts(block: pa.Array, section: pa.Array, start: pa.Array, n: pa.Array) -> pa.Array:
    """Partial sums of a block for each part of the request its rows belong to.

    History rows count for hist, for early or late (halves, from four rows on) and for recent (last three).
    """
    out = []
    for x, name, at, size in zip(_blocks(block), section.to_pylist(), start.to_pylist(), n.to_pylist()):
        place = at + np.arange(len(x))
        if name == "history":
            half = size // 2
            parts = {"hist": place >= 0, "recent": place >= size - RECENT}
            if size >= 4:
                parts |= {"early": place < half, "late": place >= half}
        else:
            parts = {"cand" if name == "candidate" else name: place >= 0}
        unit = _unit(x)
        out.append([
            {"part": p, "n": int(mask.sum()), "squares": float(np.square(x[mask]).sum()), "cells": float(x[mask].sum()),
             "vsum": x[mask].sum(axis=0), "usum": unit[mask].sum(axis=0)}
            for p, mask in parts.items() if mask.any()
        ])
    return pa.array(out, _PARTS_ARROW)


@F.arrow_udf(_NEAR)
def near_history(block: pa.Array, unit_mean: pa.Array, recent_mean: pa.Array, centroid: pa.Array) -> pa.Array:
    """Per row of a block its cosine to history and to recent history, and its distance to the centroid."""
    sides = zip(_blocks(block), _vectors(unit_mean), _vectors(recent_mean), _vectors(centroid))
    ends, columns = [0], [[], [], []]
    for x, hu, ru, hc in sides:
        u = _unit(x)
        ends.append(ends[-1] + len(x))
        for column, values in zip(columns, (u @ hu, u @ ru, np.linalg.norm(x - hc, axis=1))):
            column.append(values)
    flat = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.float64()) for c in columns]
    rows = pa.StructArray.from_arrays(flat, fields=list(_NEAR_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(_DOUBLES)
def neighbour_cosines(block: pa.Array) -> pa.Array:
    """Cosines of consecutive rows of a block."""
    return pa.array([(_unit(x)[:-1] * _unit(x)[1:]).sum(axis=1) for x in _blocks(block)], _DOUBLES_ARROW)


@F.arrow_udf(_PRODUCTS)
def pair_products(left: pa.Array, right: pa.Array, same: pa.Array) -> pa.Array:
    """Count, sum, sum of squares and minimum of the cosines between two blocks (i < j within one block)."""
    out = []
    for a, b, one in zip(_blocks(left), _blocks(right), same.to_pylist()):
        products = _unit(a) @ _unit(b).T
        values = products[np.triu_indices(len(a), k=1)] if one else products.ravel()
        low = float(values.min()) if values.size else None
        out.append((values.size, float(values.sum()), float(np.square(values).sum()), low))
    return pa.array(
        [{"cnt": c, "total": t, "squares": s, "low": low} for c, t, s, low in out],
        pa.struct([("cnt", pa.int64()), ("total", pa.float64()), ("squares", pa.float64()), ("low", pa.float64())]),
    )


_UNITS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("ones", _DOUBLE), T.StructField("fourths", _DOUBLE),
    T.StructField("total", _DOUBLES), T.StructField("gram", _DOUBLES),
])
_UNITS_ARROW = pa.struct([("n", pa.int64()), ("ones", pa.float64()), ("fourths", pa.float64()), ("total", _DOUBLES_ARROW), ("gram", _DOUBLES_ARROW)])


@F.arrow_udf(_UNITS)
def unit_sums(block: pa.Array) -> pa.Array:
    """Of the unit vectors of a block: their number, the sums of their second and fourth powers of length, sum and Gram."""
    out = []
    for x in _blocks(block):
        u = _unit(x)
        squares = np.square(u).sum(axis=1)
        out.append({"n": len(u), "ones": float(squares.sum()), "fourths": float(np.square(squares).sum()), "total": u.sum(axis=0), "gram": (u.T @ u).ravel()})
    return pa.array(out, _UNITS_ARROW)


def _angles(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ _unit(anchor), -1.0, 1.0))


@F.arrow_udf(_FARTHEST)
def widest_row(block: pa.Array, anchor: pa.Array) -> pa.Array:
    """The row of a block at the widest angle to an anchor (the first on ties), with that angle."""
    out = []
    for x, a in zip(_blocks(block), _vectors(anchor)):
        angle = _angles(x, a)
        at = int(angle.argmax())
        out.append({"gap": float(angle[at]), "v": x[at]})
    return pa.array(out, _FARTHEST_ARROW)


@F.arrow_udf(_DOUBLE)
def least_cosine(block: pa.Array, vector: pa.Array) -> pa.Array:
    """The least cosine of the rows of a block to one vector."""
    return pa.array([float((_unit(x) @ _unit(v)).min()) for x, v in zip(_blocks(block), _vectors(vector))], pa.float64())


@F.arrow_udf(T.ArrayType(_DOUBLES))
def rows_beyond(block: pa.Array, anchor: pa.Array, angle: pa.Array) -> pa.Array:
    """The rows of a block at no less than an angle to an anchor."""
    rows = zip(_blocks(block), _vectors(anchor), angle.to_pylist())
    return pa.array([list(x[_angles(x, a) >= least]) for x, a, least in rows], pa.list_(_DOUBLES_ARROW))


def _top3(gram: np.ndarray) -> float:
    return float(np.sqrt(np.clip(np.linalg.eigvalsh(gram)[-3:], 0.0, None)).sum())


@F.arrow_udf(_DOUBLE)
def top3_singular(block: pa.Array, mean: pa.Array) -> pa.Array:
    """Sum of the three largest singular values of a block around the mean, from the smaller of its two Grams."""
    centred = (x - m for x, m in zip(_blocks(block), _vectors(mean)))
    return pa.array([_top3(c @ c.T if len(c) <= c.shape[1] else c.T @ c) for c in centred], pa.float64())


@F.arrow_udf(_DOUBLES)
def centred_gram(block: pa.Array, mean: pa.Array) -> pa.Array:
    """Flattened Gram of the columns of a block around the mean; Grams of the blocks of one group add up."""
    centred = (x - m for x, m in zip(_blocks(block), _vectors(mean)))
    return pa.array([(c.T @ c).ravel() for c in centred], _DOUBLES_ARROW)


@F.arrow_udf(_DOUBLE)
def top3_from_gram(grams: pa.Array) -> pa.Array:
    """The same sum from the added Grams."""
    flat = _vectors(grams)
    width = int(round(flat.shape[1] ** 0.5))
    return pa.array([_top3(g.reshape(width, width)) for g in flat], pa.float64())


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.square(x - c).sum(axis=1) for c in centres], axis=1)


def farthest_first(x: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Seeds: the first row, then repeatedly the row farthest from all seeds (first one on ties)."""
    seeds = [0]
    while len(seeds) < k:
        seeds.append(int(_squared(x, x[seeds]).min(axis=1).argmax()))
    return x[seeds]


def lloyd(x: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Cluster labels once no label moves; a cluster that runs empty keeps its centre, ties go to the lower label."""
    centres = farthest_first(x, k).copy()
    labels = _squared(x, centres).argmin(axis=1)
    while True:
        for j in range(k):
            if (labels == j).any():
                centres[j] = x[labels == j].mean(axis=0)
        moved = _squared(x, centres).argmin(axis=1)
        if (moved == labels).all():
            return labels
        labels = moved


@F.arrow_udf(_FARTHEST)
def farthest_row(block: pa.Array, centres: pa.Array) -> pa.Array:
    """The row of a block farthest from its nearest centre (the first on ties), with its squared distance."""
    out = []
    for x, c in zip(_blocks(block), _blocks(centres)):
        gaps = _squared(x, c).min(axis=1)
        at = int(gaps.argmax())
        out.append({"gap": float(gaps[at]), "v": x[at]})
    return pa.array(out, _FARTHEST_ARROW)


@F.arrow_udf(_INTS)
def nearest_labels(block: pa.Array, centres: pa.Array) -> pa.Array:
    """The nearest centre of every row of a block, the lower one on ties."""
    labels = [_squared(x, c).argmin(axis=1) for x, c in zip(_blocks(block), _blocks(centres))]
    return pa.array(labels, pa.list_(pa.int32()))


@F.arrow_udf(_SUMS)
def label_sums(block: pa.Array, labels: pa.Array) -> pa.Array:
    """Rows and vector sum of each label that occurs in a block."""
    out = []
    for x, given in zip(_blocks(block), labels):
        own = given.values.to_numpy()
        out.append([
            {"label": j, "n": int((own == j).sum()), "total": x[own == j].sum(axis=0)}
            for j in range(CLUSTERS) if (own == j).any()
        ])
    return pa.array(out, _SUMS_ARROW)


@F.arrow_udf(_INTS)
def cluster_labels(block: pa.Array) -> pa.Array:
    """Label of every row of a block; blocks with fewer rows than clusters get none."""
    return pa.array([lloyd(x) if len(x) >= CLUSTERS else [] for x in _blocks(block)], pa.list_(pa.int32()))


@F.arrow_udf(_DOUBLES)
def label_distances(left: pa.Array, left_labels: pa.Array, right: pa.Array, right_labels: pa.Array, same: pa.Array) -> pa.Array:
    """Per cluster the sum of distances over ordered pairs between two blocks (a block with itself once)."""
    out = []
    rows = zip(_blocks(left), left_labels.to_pylist(), _blocks(right), right_labels.to_pylist(), same.to_pylist())
    for a, la, b, lb, one in rows:
        la, lb = np.asarray(la or []), np.asarray(lb or [])
        if len(la) * len(lb) <= SMALL:  # all distances at once, a small table
            gaps = np.linalg.norm(a[:len(la), None] - b[None, :len(lb)], axis=2) if len(la) and len(lb) else np.zeros((len(la), len(lb)))
            sums = [float(gaps[np.ix_(la == j, lb == j)].sum()) * (1.0 if one else 2.0) for j in range(CLUSTERS)]
            out.append(sums)
            continue
        sums = []
        for j in range(CLUSTERS):
            p, q = a[la == j] if len(la) else a[:0], b[lb == j] if len(lb) else b[:0]
            total = sum(np.linalg.norm(p - row, axis=1).sum() for row in q) if len(p) else 0.0
            sums.append(float(total) if one else 2.0 * float(total))
        out.append(sums)
    return pa.array(out, pa.list_(pa.float64()))


def margins_function(weights: np.ndarray, bias: np.ndarray, yes: list[list[int]], no: list[list[int]]):
    """Arrow function vec -> one margin per verbalizer set: logsumexp of the yes logits minus that of the no logits.

    ``weights`` holds the few output rows of the verbalizer tokens; yes and no list its rows per set.
    """

    def logsumexp(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]

    @F.arrow_udf(_DOUBLES)
    def margins(vec: pa.Array) -> pa.Array:
        if not len(vec):
            return pa.array([], _DOUBLES_ARROW)
        logits = _vectors(vec) @ weights.T + bias
        columns = [logsumexp(logits[:, y]) - logsumexp(logits[:, n]) for y, n in zip(yes, no)]
        return pa.array(list(np.stack(columns, axis=1)), _DOUBLES_ARROW)

    return margins
