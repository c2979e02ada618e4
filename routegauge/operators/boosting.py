"""Gradient boosting on histograms that Spark adds up.

Rows are stored once as blocks of binned features. A level of a tree is one scan: every task adds up gradients, curvatures
and counts per (model, node, feature, bin), Spark adds these sums over the tasks, and the driver, which sees no more than
that table, picks the splits. Several models, such as the folds of a cross-validation, share every scan. Scores of the rows
are carried along in the blocks and brought up to date every few rounds; the trees since then are applied within the scan.
Nothing is fitted twice: a fit goes on from round to round until its validation rows have not gained for ``patience`` rounds.

A job per level is dear where the rows are few: up to ``HELD_BYTES`` a model's rows are held by one task, which takes the same
rounds over them, and every model has a task of its own (``held_rows``). Larger tables go by scans.

Sums are kept in fixed point, so they do not depend on the order of the tasks and a fit can be repeated exactly.

Two objectives are known. ``squared`` fits a label. ``ndcg`` ranks all training rows of a model as one list: the gradient of
a row is the sum, over pairs with the rows that lead the list, of the change of NDCG that swapping the two would make. The
leaders are a list of bounded length, so the pairs grow with the rows and not with their square; what a task's rows add to
the gradient of a leader is added to the leader's bins, since all sums are linear in the gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routegauge.session import discard, scratch_path, ship_package

TRAIN, VALID = 1, 2
STORE_EVERY = 20  # rounds between two updates of the stored scores
DIRECT_PARTS = 64  # up to so many partitions the driver adds their sums itself
PART_ROWS = 20_000
HELD_BYTES = 320 << 20  # what a task may hold for the fit of one model; more rows are fitted by scans
LEADERS = 30  # places of the list that pairs are formed with
VALID_PLACES = 10
_FINEST = 36  # bits behind the point of fixed-point sums, at most
HELD_ROW = 56  # bytes that a task holds of a row besides its bins
_LEAST_CURVATURE = 1e-3
_SUMS = "model int, slot int, feature int, bin int, g long, h long, n long"
_BLOCKS = "block long, n int, bins binary, y binary, w binary, parts binary, score binary"
_PICKS = "model int, slot int, feature int, border int, gain double, lg double, lh double, ln double, rg double, rh double, rn double"
_LEADING = "model int, part int, score double, block long, row int, y double, w double, bins binary"


@dataclass(frozen=True)
class Settings:
    """How trees grow: level by level to ``depth``, with at least ``least_rows`` rows in a leaf and a penalty on leaf values."""

    rounds: int = 100
    patience: int = 10
    depth: int = 5
    rate: float = 0.05
    least_rows: int = 20
    l2: float = 1e-4
    bins: int = 255
    objective: str = "squared"
    best_round: bool = True  # keep the trees up to the best round, else all
    direction: dict[str, int] = field(default_factory=dict)  # 1: the score never falls in the column, -1: it never rises


@dataclass
class Tree:
    """A binary tree in heap order; ``feature`` is -1 at leaves, a bin up to ``border`` goes left."""

    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that every row has reached."""
        at = np.zeros(len(bins), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            at[inner] = 2 * at[inner] + 1 + (bins[inner, f[inner]] > self.border[at[inner]])


@dataclass
class Model:
    """Boosted trees over named columns."""

    features: list[str]
    cuts: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = binned(columns, self.cuts)
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += self.rate * tree.value[tree.places(bins)]
        return out

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the score; missing values count as 0."""
        return transform_by([self], df, F.lit(0), name)


def transform_by(models: list[Model], df: DataFrame, which: Column, name: str = "prediction") -> DataFrame:
    """Add the score of the model whose number is ``which``; all models are applied in one scan."""
    ship_package(df.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(number: pd.Series, *columns: pd.Series) -> pd.Series:
        out = np.zeros(len(number))
        for m, model in enumerate(models):
            rows = np.flatnonzero(number.to_numpy() == m)
            if len(rows):
                out[rows] = model.score([c.to_numpy()[rows] for c in columns])
        return pd.Series(out)

    return df.withColumn(name, score(which.cast("int"), *[_plain(c) for c in models[0].features]))


def _plain(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: the number of cuts below it."""
    return np.stack([np.searchsorted(c, x, "left") for x, c in zip(columns, cuts, strict=True)], axis=1).astype(np.uint8)


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 255) -> list[np.ndarray]:
    """At most ``bins - 1`` ascending cuts for every column, at quantiles of its values."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(_plain(c), probs, 20_000).alias(f"c{i}") for i, c in enumerate(features)],
                 *[F.max(_plain(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [np.array(sorted({x for x in row[f"c{i}"] or [] if x < row[f"m{i}"]}), float) for i in range(len(features))]


def even_cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """``bins - 1`` evenly spaced cuts between the least and the largest value of every column."""
    row = df.agg(*[F.struct(F.min(_plain(c)), F.max(_plain(c))).alias(f"c{i}") for i, c in enumerate(features)]).first()
    ends = [(lo or 0.0, hi or 0.0) for lo, hi in row]
    return [np.array([lo + (hi - lo) * (i / bins) for i in range(1, bins)]) for lo, hi in ends]


# --- blocks -----------------------------------------------------------------------------------------


def _pack(cuts: list[np.ndarray], models: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cuts) + 2)]
            parts = np.array(batch.column(len(cuts) + 2).to_pylist(), np.uint8).reshape(n, models)
            packed = [binned(columns[:-2], cuts), columns[-2], columns[-1], parts, np.zeros((n, models))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([n], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
                names=["block", "n", "bins", "y", "w", "parts", "score"],
            )
            number += 1

    return apply


@dataclass
class _Block:
    number: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    parts: np.ndarray
    score: np.ndarray


def _unpack(batches: Iterator[pa.RecordBatch], features: int, models: int) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            number, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            bins, y, w, parts, score = (batch.column(c)[i].as_buffer() for c in range(2, 7))
            yield _Block(
                number, np.frombuffer(bins, np.uint8).reshape(n, features), np.frombuffer(y), np.frombuffer(w),
                np.frombuffer(parts, np.uint8).reshape(n, models), np.frombuffer(score).reshape(n, models),
            )


@dataclass
class _Fit:
    """What the driver knows of one model."""

    number: int
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    stored: int = 0  # trees whose values the stored scores hold
    best: float = -np.inf
    best_at: int = 0
    done: bool = False
    top_gain: float = 0.0  # the largest DCG of the training rows
    valid_gain: float = 0.0
    leaders: list = field(default_factory=list)


@dataclass
class _Shared:
    """What tasks need to know of a model: trees not yet in the scores, the growing tree and its open nodes."""

    number: int
    start: float
    recent: list[Tree]
    growing: Tree | None
    slots: np.ndarray | None
    leaders: list
    top_gain: float

    def scores(self, block: _Block, rate: float) -> np.ndarray:
        out = self.start + block.score[:, self.number]
        for tree in self.recent:
            out = out + rate * tree.value[tree.places(block.bins)]
        return out


def _gradients(model: _Shared, block: _Block, rows: np.ndarray, score: np.ndarray, objective: str):
    """(gradients, curvatures) of rows, and of the leaders as far as these rows bear on them (with the sum of all changes)."""
    y, w = block.y[rows], block.w[rows]
    if objective == "squared":
        return w * (score - y), w, None
    own = {}  # rows that lead the list, with their place
    for i, leader in enumerate(model.leaders):
        at = int(np.searchsorted(rows, leader["row"])) if leader["block"] == block.number else len(rows)
        if at < len(rows) and rows[at] == leader["row"]:
            own[at] = i
    lead_score, lead_y, lead_w = (np.array([x[c] for x in model.leaders], float) for c in ("score", "y", "w"))
    discount = 1 / np.log2(np.arange(len(model.leaders)) + 2.0) / max(model.top_gain, 1e-300)
    g, h, lead_g, lead_h, total = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(lead_y)), np.zeros(len(lead_y)), 0.0

    def pushed(y, score, other_y, other_score):
        """How far up a row is pushed by its pair with another one of discount 1, against which it has none, and the curvature."""
        away, apart = y - other_y, score - other_score
        side = np.sign(away)
        p = 1 / (1 + np.exp(np.clip(side * apart, -50, 50)))
        push = p * (np.abs(away) / (0.01 + np.abs(apart)))
        return side * push, push * (1 - p), push

    behind = np.delete(np.arange(len(rows)), list(own)) if own else slice(None)
    far_y, far_score = y[behind], score[behind]
    kinds, kind = np.unique(np.stack([lead_score, lead_y], axis=1), axis=0, return_inverse=True)
    up, bend, both = np.zeros(len(far_y)), np.zeros(len(far_y)), np.zeros((len(kinds), 2))
    for k, share in enumerate(np.bincount(kind.ravel(), discount, len(kinds))):  # leaders of equal score and label push alike
        push, curve, change = pushed(far_y, far_score, kinds[k, 1], kinds[k, 0])
        both[k] = push.sum(), curve.sum()
        total += share * change.sum()
        up += share * push
        bend += share * curve
    g[behind], h[behind] = -up, bend
    lead_g += discount * both[kind.ravel(), 0]
    lead_h += discount * both[kind.ravel(), 1]
    for at, place in own.items():
        push, curve, change = pushed(y[at], score[at], lead_y[:place], lead_score[:place])
        less = discount[:place] - discount[place]
        g[at], h[at] = -(less * push).sum(), (less * curve).sum()
        lead_g[:place] += less * push
        lead_h[:place] += less * curve
        total += (less * change).sum()
    return w * g, w * h, (lead_w * lead_g, lead_w * lead_h, 2 * total)


def unit_of(rows: int) -> float:
    """The fixed-point one that lets sums over so many rows, of up to 64 each, stay within 63 bits."""
    return float(1 << max(min(_FINEST, 57 - int(rows).bit_length()), 8))


def _histograms(models: list[_Shared], features: int, bins: int, count: int, settings: Settings, one: float):
    def _fixed(x: np.ndarray) -> np.ndarray:
        return np.rint(x * one)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((int(m.slots.max()) + 1, features, bins, 3), np.int64) for m in models]
        extra = np.zeros((len(models), 3), np.int64)  # changes of NDCG, or squared errors and weights of validation rows
        for block in _unpack(batches, features, count):
            for m, model in enumerate(models):
                score = model.scores(block, settings.rate)
                rows = np.flatnonzero(block.parts[:, model.number] == TRAIN)
                g, h, lead = _gradients(model, block, rows, score[rows], settings.objective)
                slot = model.slots[model.growing.places(block.bins[rows])]
                values = np.stack([_fixed(g), _fixed(h), np.ones(len(rows))])
                entries = [(block.bins[rows], slot, values)]
                if lead is not None:
                    own = np.array([np.frombuffer(x["bins"], np.uint8) for x in model.leaders]).reshape(-1, features)
                    entries.append((own, model.slots[model.growing.places(own)], np.stack([_fixed(lead[0]), _fixed(lead[1]), np.zeros(len(own))])))
                    extra[m, 0] += int(_fixed(lead[2]))
                else:
                    v = block.parts[:, model.number] == VALID
                    extra[m] += _fixed(np.array([(block.w[v] * (block.y[v] - score[v]) ** 2).sum(), block.w[v].sum(), 0])).astype(np.int64)
                for where, at, what in entries:
                    open_rows = np.flatnonzero(at >= 0)
                    for f in range(features):
                        cell = at[open_rows] * bins + where[open_rows, f]
                        for c in range(3):
                            got = np.bincount(cell, what[c, open_rows], sums[m].shape[0] * bins)
                            sums[m][:, f, :, c] += got.reshape(-1, bins).astype(np.int64)
        out = []
        for m, model in enumerate(models):
            slot, f, b = np.nonzero(sums[m].any(axis=3))
            out.append(np.c_[np.full(len(slot), model.number), slot, f, b, sums[m][slot, f, b]])
            out.append(np.array([[model.number, -1, -1, -1, *extra[m]]]))
        table = np.concatenate(out)
        types = [pa.int32()] * 4 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(table[:, i]).cast(t) for i, t in enumerate(types)], names=["model", "slot", "feature", "bin", "g", "h", "n"])

    return apply


def _first(rows: list[dict], places: dict[int, int]) -> list[dict]:
    """The leading rows of every (model, part), equal scores in the order of the blocks."""
    rows = sorted(rows, key=lambda x: (x["model"], x["part"], -x["score"], x["block"], x["row"]))
    out, seen = [], {}
    for x in rows:
        at = seen[x["model"], x["part"]] = seen.get((x["model"], x["part"]), 0) + 1
        if at <= places[x["part"]]:
            out.append(x)
    return out


def _leading(models: list[_Shared], features: int, count: int, rate: float, places: dict[int, int]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for block in _unpack(batches, features, count):
            for model in models:
                score = model.scores(block, rate)
                for part, most in places.items():
                    rows = np.flatnonzero(block.parts[:, model.number] == part)
                    for r in rows[np.lexsort((rows, -score[rows]))[:most]].tolist():
                        held.append({"model": model.number, "part": part, "score": score[r], "block": block.number, "row": r,
                                     "y": block.y[r], "w": block.w[r], "bins": block.bins[r].tobytes()})
            held = _first(held, places)
        yield from pa.Table.from_pylist(held, _LEADING_ARROW).to_batches()

    return apply


_LEADING_ARROW = pa.schema([("model", pa.int32()), ("part", pa.int32()), ("score", pa.float64()), ("block", pa.int64()), ("row", pa.int32()),
                            ("y", pa.float64()), ("w", pa.float64()), ("bins", pa.binary())])


def _merge_leading(places: dict[int, int]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held = _first(held + batch.to_pylist(), places)
        yield from pa.Table.from_pylist(held, _LEADING_ARROW).to_batches()

    return apply


def _rescored(models: list[_Shared], features: int, count: int, rate: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for block in _unpack(iter([batch]), features, count):
                score = block.score.copy()
                for model in models:
                    score[:, model.number] = model.scores(block, rate) - model.start
                scores.append(score.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(scores, pa.binary())], names=batch.schema.names)

    return apply


# --- splits -----------------------------------------------------------------------------------------


@dataclass
class Split:
    feature: int
    border: int
    gain: float
    left: tuple[float, float, float]  # gradient, curvature, rows
    right: tuple[float, float, float]


def _leaf(g, h, l2: float, low: float, high: float):
    return np.clip(-g / (h + l2 + 1e-300), low, high)


def _merit(g, h, l2: float, value):
    return -(2 * g * value + (h + l2) * value * value)


def best_split(sums: np.ndarray, settings: Settings, direction: np.ndarray, low: float = -np.inf, high: float = np.inf) -> Split | None:
    """The split of a node with the largest gain, from sums (feature, bin, 3); equal gains go to the first feature and bin.

    Leaf values stay within ``low`` and ``high``; along a directed feature the two sides must not be in the wrong order.
    """
    total = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total - left
    a, b = (_leaf(x[..., 0], x[..., 1], settings.l2, low, high) for x in (left, right))
    parent = _merit(total[0], total[1], settings.l2, _leaf(total[0], total[1], settings.l2, low, high))
    gain = _merit(left[..., 0], left[..., 1], settings.l2, a) + _merit(right[..., 0], right[..., 1], settings.l2, b) - parent
    fit = np.minimum(left[..., 2], right[..., 2]) >= settings.least_rows
    fit &= np.minimum(left[..., 1], right[..., 1]) >= _LEAST_CURVATURE
    fit &= (b - a) * direction[:, None] >= 0
    gain = np.where(fit, gain, -np.inf)
    if not gain.size or gain.max() <= 1e-12:
        return None
    f, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return Split(int(f), int(at), float(gain[f, at]), tuple(left[f, at].tolist()), tuple(right[f, at].tolist()))


def _add_up(cells: dict[tuple[int, int], np.ndarray], columns: list[np.ndarray], features: int, bins: int) -> None:
    """Add rows (model, slot, feature, bin, g, h, n) to the sums (feature, bin, 3) of their node; slot -1 holds the further sums."""
    model, slot, f, b, *values = columns
    pairs, which = np.unique(np.stack([model, slot]), axis=1, return_inverse=True)
    values, which = np.stack(values, axis=1), which.ravel()
    order = np.argsort(which, kind="stable")
    for (m, s), rows in zip(pairs.T.tolist(), np.split(order, np.cumsum(np.bincount(which))[:-1]), strict=True):
        if s < 0:
            cells[m, s] = cells.get((m, s), 0) + values[rows].sum(axis=0)
        else:
            held = cells.setdefault((m, s), np.zeros((features, bins, 3), np.int64))
            np.add.at(held, (f[rows], b[rows]), values[rows])


def _picker(bounds: dict[tuple[int, int], tuple[float, float]], scale: dict[int, float], shape: tuple[int, int], one: float,
            direction: np.ndarray, settings: Settings):
    """Adds up the sums of whole nodes and picks their splits: one row per (model, slot), slot -1 with the further sums."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                _add_up(cells, [c.to_numpy() for c in batch.columns], *shape)
        out = []
        for (m, s), held in cells.items():
            if s < 0:
                out.append((m, s, -1, -1, 0.0, *(held / one).tolist(), 0.0, 0.0, 0.0))
            elif (found := best_split(held / [one, one, 1.0] * [scale[m], scale[m], 1.0], settings, direction, *bounds[m, s])) is not None:
                out.append((m, s, found.feature, found.border, found.gain, *found.left, *found.right))
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] * 4 + [pa.float64()] * 7, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PICKS.split(", ")])

    return apply


class Rounds:
    """The rounds of a fit: trees grown level by level and when to stop. What lies below says how the rows are read.

    It has ``settings``, ``fits`` and ``direction``, and answers ``leading``, ``sums``, ``picks`` and ``store_scores``.
    """

    def _shared(self, fit: _Fit, tree: Tree | None = None, slots: np.ndarray | None = None) -> _Shared:
        return _Shared(fit.number, fit.start, fit.trees[fit.stored :], tree, slots, fit.leaders, fit.top_gain)

    def _find_leaders(self, fits: list[_Fit]) -> None:
        """The leaders of the training rows, and the metric of the validation rows."""
        rows = self.leading(fits, {TRAIN: LEADERS, VALID: VALID_PLACES})
        for fit in fits:
            fit.leaders = [x for x in rows if x["model"] == fit.number and x["part"] == TRAIN]
            held = [x for x in rows if x["model"] == fit.number and x["part"] == VALID]
            if held:
                gained = sum(x["y"] / np.log2(i + 2) for i, x in enumerate(held))
                self._judge(fit, gained / fit.valid_gain if fit.valid_gain else 1.0)

    def _judge(self, fit: _Fit, metric: float) -> None:
        """A metric of the trees so far, the larger the better."""
        if not fit.trees:
            return
        if metric > fit.best:
            fit.best, fit.best_at = metric, len(fit.trees)
        elif len(fit.trees) - fit.best_at >= self.settings.patience:
            fit.done = True

    def _grow(self, fits: list[_Fit]) -> None:
        """One tree for every model that still gains."""
        trees = {f.number: Tree.empty(self.settings.depth) for f in fits}
        open_nodes = {f.number: {0: (-np.inf, np.inf)} for f in fits}
        scale = {f.number: 1.0 for f in fits}
        for level in range(self.settings.depth):
            growing = [f for f in fits if open_nodes[f.number] and not f.done]
            if not growing:
                break
            shared = []
            for f in growing:
                slots = np.full(len(trees[f.number].feature), -1)
                slots[list(open_nodes[f.number])] = np.arange(len(open_nodes[f.number]))
                shared.append(self._shared(f, trees[f.number], slots))
            bounds = {(f.number, s): b for f in growing for s, b in enumerate(open_nodes[f.number].values())}
            if level == 0 and self.settings.objective == "ndcg":  # roots are scaled by a sum over all rows
                sums, more = self.sums(shared)
                for f in growing:
                    total = more[f.number]
                    scale[f.number] = np.log2(1 + total[0]) / total[0] if total[0] > 0 else 1.0
                one = {k: v * [scale[k[0]], scale[k[0]], 1.0] for k, v in sums.items()}
                splits = {k: best_split(v, self.settings, self.direction, *bounds[k]) for k, v in one.items()}
            else:
                splits, more = self.picks(shared, bounds, scale)
            for f in growing:
                if level == 0 and self.settings.objective != "ndcg" and more[f.number][1] > 0:
                    self._judge(f, -more[f.number][0] / more[f.number][1])
                    if f.done:
                        continue
                self._split(f, trees[f.number], open_nodes, splits, level)
        for f in fits:
            if not f.done:
                f.trees.append(trees[f.number])
                self.grown(f)

    def _split(self, fit: _Fit, tree: Tree, open_nodes: dict, splits: dict, level: int) -> None:
        children = {}
        for slot, (node, (low, high)) in enumerate(open_nodes[fit.number].items()):
            found = splits.get((fit.number, slot))
            if found is None:
                if level == 0:
                    fit.done = True
                continue
            tree.feature[node], tree.border[node] = found.feature, found.border
            bounds = [(low, high), (low, high)]
            values = [float(_leaf(g, h, self.settings.l2, low, high)) for g, h, _ in (found.left, found.right)]
            if self.direction[found.feature]:
                middle = sum(values) / 2
                bounds = [(low, middle), (middle, high)] if self.direction[found.feature] > 0 else [(middle, high), (low, middle)]
            for side, (child, bound) in enumerate(zip((2 * node + 1, 2 * node + 2), bounds, strict=True)):
                tree.value[child] = min(max(values[side], bound[0]), bound[1])
                if (found.left, found.right)[side][2] >= 2 * self.settings.least_rows:
                    children[child] = bound
        open_nodes[fit.number] = children

    def grown(self, fit: _Fit) -> None:
        """What is to be done once a tree of a model is whole."""

    def run(self, store_every: int | None = None) -> None:
        store_every = store_every or STORE_EVERY
        for done in range(self.settings.rounds + 1):
            active = [f for f in self.fits if not f.done]
            if self.settings.objective == "ndcg" and active:
                self._find_leaders(active)
                active = [f for f in active if not f.done]
            if not active or done == self.settings.rounds:
                break
            self._grow(active)
            if done % store_every == store_every - 1:
                self.store_scores()


class Booster(Rounds):
    """Fits one model for every part of a table, all in the same scans."""

    def __init__(self, rows: DataFrame, features: list[str], label: str, weight: str | None, parts: list[Column], settings: Settings,
                 cuts: list[np.ndarray] | None = None):
        """``parts`` tells, per model, which rows train it (1), which decide when it stops (2), and which it does not see (0).

        ``rows`` should be stored. Missing features and labels count as 0.
        """
        self.spark, self.features, self.settings = rows.sparkSession, features, settings
        ship_package(self.spark)
        self.cuts = cuts or quantile_cuts(rows, features, settings.bins)
        self.bins = max(map(len, self.cuts)) + 1
        self.direction = np.array([settings.direction.get(c, 0) for c in features])
        self.fits = [_Fit(i) for i in range(len(parts))]
        plain = rows.select(
            *[_plain(c).alias(f"f{i}") for i, c in enumerate(features)], _plain(label).alias("y"),
            (_plain(weight) if weight else F.lit(1.0)).alias("w"), F.array(*[p.cast("int") for p in parts]).alias("parts"),
        )
        plain = plain.filter(F.exists("parts", lambda p: p != 0))
        self.rows = plain.count()
        self.path = scratch_path(self.spark, "boost")
        plain = plain.coalesce(self.rows // PART_ROWS + 1)  # fewer tasks for few rows; more rows keep their partitions
        plain.mapInArrow(_pack(self.cuts, len(parts)), _BLOCKS).write.parquet(self.path)
        self.blocks = self.spark.read.schema(_BLOCKS).parquet(self.path)
        self._begin(plain)

    def _begin(self, plain: DataFrame) -> None:
        n = len(self.fits)
        self.one = unit_of(self.rows)
        if self.settings.objective == "squared":
            inside = [F.when(F.col("parts")[i] == TRAIN, F.col("w")) for i in range(n)]
            row = plain.agg(*[F.sum(c * F.col("y")).alias(f"y{i}") for i, c in enumerate(inside)], *[F.sum(c).alias(f"w{i}") for i, c in enumerate(inside)]).first()
            for i, fit in enumerate(self.fits):
                fit.start = row[f"y{i}"] / row[f"w{i}"] if row[f"w{i}"] else 0.0
            return
        for i, fit in enumerate(self.fits):
            for part, most in ((TRAIN, LEADERS), (VALID, VALID_PLACES)):
                best = plain.filter(F.col("parts")[i] == part).orderBy(F.desc("y")).limit(most).select("y").collect()
                top = sum(r["y"] / np.log2(at + 2) for at, r in enumerate(best))
                fit.top_gain, fit.valid_gain = (top, fit.valid_gain) if part == TRAIN else (fit.top_gain, top)

    def _few(self) -> bool:
        return self.blocks.rdd.getNumPartitions() <= DIRECT_PARTS

    def sums(self, shared: list[_Shared]) -> tuple[dict[tuple[int, int], np.ndarray], dict[int, np.ndarray]]:
        """Sums (feature, bin, 3) of every open (model, node slot), and the further sums of every model."""
        found = self.blocks.mapInArrow(_histograms(shared, len(self.features), self.bins, len(self.fits), self.settings, self.one), _SUMS)
        if not self.few:
            keys = ["model", "slot", "feature", "bin"]
            found = found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        cells = {(m.number, s): np.zeros((len(self.features), self.bins, 3), np.int64) for m in shared for s in range(int(m.slots.max()) + 1)}
        cells |= {(m.number, -1): np.zeros(3, np.int64) for m in shared}
        _add_up(cells, [c.to_numpy() for c in found.toArrow().columns], len(self.features), self.bins)
        unit = np.array([self.one, self.one, 1.0])
        return {k: v / unit for k, v in cells.items() if k[1] >= 0}, {m.number: cells[m.number, -1] / self.one for m in shared}

    def picks(self, shared: list[_Shared], bounds: dict[tuple[int, int], tuple[float, float]], scale: dict[int, float]):
        """The best split of every open (model, node slot), and the further sums of every model.

        The sums of a node meet in one task, which picks its split: the driver gets one row per node, whatever the number of tasks.
        """
        found = self.blocks.mapInArrow(_histograms(shared, len(self.features), self.bins, len(self.fits), self.settings, self.one), _SUMS)
        if self.parts > 1:
            found = found.repartition(min(len(bounds), self.spark.sparkContext.defaultParallelism), "model", "slot")
        picker = _picker(bounds, scale, (len(self.features), self.bins), self.one, self.direction, self.settings)
        rows = found.mapInArrow(picker, _PICKS).toArrow().to_pylist()
        splits = {
            (r["model"], r["slot"]): Split(r["feature"], r["border"], r["gain"], (r["lg"], r["lh"], r["ln"]), (r["rg"], r["rh"], r["rn"]))
            for r in rows if r["slot"] >= 0
        }
        more = {m.number: np.zeros(3) for m in shared} | {r["model"]: np.array([r["lg"], r["lh"], r["ln"]]) for r in rows if r["slot"] < 0}
        return splits, more

    def leading(self, fits: list[_Fit], places: dict[int, int]) -> list[dict]:
        found = self.blocks.mapInArrow(_leading([self._shared(f) for f in fits], len(self.features), len(self.fits), self.settings.rate, places), _LEADING)
        if not self.few:
            found = found.repartition(1).mapInArrow(_merge_leading(places), _LEADING)  # no more than 40 rows a task and model
        return _first(found.toArrow().to_pylist(), places)

    def store_scores(self) -> None:
        """Write the scores of all rows anew and drop the former blocks."""
        changed = [self._shared(f) for f in self.fits]
        path = scratch_path(self.spark, "boost")
        self.blocks.mapInArrow(_rescored(changed, len(self.features), len(self.fits), self.settings.rate), _BLOCKS).write.parquet(path)
        discard(self.spark, self.path)
        self.path, self.blocks = path, self.spark.read.schema(_BLOCKS).parquet(path)
        for f in self.fits:
            f.stored = len(f.trees)

    def held(self) -> bool:
        """Whether a task may hold the rows of a model for its whole fit."""
        return self.rows * (len(self.features) + HELD_ROW) <= HELD_BYTES

    def fit(self) -> list[Model]:
        if self.held():
            from routegauge.operators.held_rows import fit_held

            self.fits = fit_held(self)
        else:
            self.parts = self.blocks.rdd.getNumPartitions()
            self.few = self._few()
            self.run()
        discard(self.spark, self.path)
        out = []
        for f in self.fits:
            kept = f.best_at if self.settings.best_round and f.best > -np.inf else len(f.trees)
            out.append(Model(self.features, self.cuts, f.start, self.settings.rate, f.trees[:kept]))
        return out


def first_sums(rows: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[np.ndarray], settings: Settings) -> DataFrame:
    """(feature, bin, g, h, n): what the root of the first tree is split by."""
    booster = Booster(rows, features, label, weight, [F.lit(TRAIN)], settings, cuts)
    fit = booster.fits[0]
    shared = [booster._shared(fit, Tree.empty(0), np.zeros(1, np.int64))]
    found = booster.blocks.mapInArrow(_histograms(shared, len(features), booster.bins, 1, settings, booster.one), _SUMS).filter("slot >= 0")
    names = F.array(*[F.lit(c) for c in features])
    return found.groupBy(F.get(names, F.col("feature")).alias("feature"), "bin").agg(
        (F.sum("g") / booster.one).alias("g"), (F.sum("h") / booster.one).alias("h"), F.sum("n").alias("n")
    )
