"""Isotonic calibration of tables of any size: pooling inside score ranges, then across the borders of ranges.

Scores are not rounded. The fit is a table of steps (lo, hi, value, weight); between two steps the calibrated score is
interpolated, outside all steps it is the nearest step's value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge.session import cut_lineage

_STATE = "part int, lo double, hi double, w double, wy double"


def pool_adjacent(blocks: list[list[float]], rows) -> list[list[float]]:
    """Append rows (lo, hi, w, wy) in score order and merge neighbours until their means rise."""
    for row in rows:
        here = list(row)
        while blocks and blocks[-1][3] * here[2] >= here[3] * blocks[-1][2]:
            lo, _, w, wy = blocks.pop()
            here = [lo, here[1], here[2] + w, here[3] + wy]
        blocks.append(here)
    return blocks


def _frame(part: int, blocks: list[list[float]]) -> pd.DataFrame:
    table = pd.DataFrame(blocks, columns=["lo", "hi", "w", "wy"])
    table.insert(0, "part", part)
    return table


def _pool_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    blocks: list[list[float]] = []
    for batch in batches:
        pool_adjacent(blocks, batch[["lo", "hi", "w", "wy"]].itertuples(index=False))
    if blocks:
        yield _frame(TaskContext.get().partitionId(), blocks)


def _pool_merged(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    rows = table.sort_values("lo")[["lo", "hi", "w", "wy"]].itertuples(index=False)
    return _frame(key[0], pool_adjacent([], rows))


def _merges(ends: list) -> list[tuple[int, int]]:
    """(part, new part) of neighbouring ranges whose border still falls, each range in one pair at most."""
    out, i = [], 0
    while i + 1 < len(ends):
        if ends[i]["last"] >= ends[i + 1]["first"]:
            out += [(ends[i]["part"], ends[i]["part"]), (ends[i + 1]["part"], ends[i]["part"])]
            i += 1
        i += 1
    return out


def fit_isotonic(df: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Steps lo, hi, value, weight of the non-decreasing least-squares fit. Rows with a null or no weight do not count.

    Equal scores are added up first, so a score that holds a third of all rows is one row. Ranges are pooled on their
    own; then pairs of neighbours are pooled again while the means fall across their border. The driver sees the two
    end values of each range.
    """
    w = F.lit(1.0) if weight is None else weight
    points = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"), w.cast("double").alias("w"))
    sums = points.filter(F.col("lo").isNotNull() & F.col("y").isNotNull() & (F.col("w") > 0)).groupBy("lo").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")
    )
    laid_out = sums.repartitionByRange("lo").sortWithinPartitions("lo").select("lo", F.col("lo").alias("hi"), "w", "wy")
    state = cut_lineage(laid_out.mapInPandas(_pool_range, _STATE))
    value = F.col("wy") / F.col("w")
    while True:
        borders = state.groupBy("part").agg(F.min_by(value, "lo").alias("first"), F.max_by(value, "lo").alias("last"))
        pairs = _merges(borders.orderBy("part").collect())  # one row per range
        if not pairs:
            return state.select("lo", "hi", value.alias("value"), F.col("w").alias("weight"))
        into = df.sparkSession.createDataFrame(pairs, "part int, into int")
        marked = state.join(F.broadcast(into), "part", "left")  # at most one row per range
        pooled = marked.filter(F.col("into").isNotNull()).groupBy("into").applyInPandas(_pool_merged, _STATE)
        state = cut_lineage(marked.filter(F.col("into").isNull()).drop("into").unionByName(pooled))


def calibrate(steps: DataFrame, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """Add the calibrated score; a null score stays null.

    Distinct scores and the ends of the steps are laid out in one order, in which each score finds the knots around it;
    rows then look their score up.
    """
    knot = F.struct("x", "v")
    knots = steps.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), F.col("value").alias("v"))
    asked = df.select(F.col(score).cast("double").alias("x")).filter(F.col("x").isNotNull()).distinct()
    both = knots.unionByName(asked.withColumn("v", F.lit(None).cast("double")))
    laid_out = cut_lineage(both.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    here = F.when(F.col("v").isNotNull(), knot)
    own = Window.partitionBy("part")

    def until(order: Column):
        return own.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    ends = laid_out.groupBy("part").agg(F.max(here).alias("high"), F.min(here).alias("low"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(  # one row per range
        "part", F.last("high", True).over(below).alias("before"), F.last("low", True).over(above).alias("after")
    )
    found = laid_out.withColumns({
        "lower": F.last(here, True).over(until(F.col("x"))), "upper": F.last(here, True).over(until(F.col("x").desc()))
    }).filter(F.col("v").isNull()).join(F.broadcast(carried), "part")
    a, b = F.coalesce("lower", "before"), F.coalesce("upper", "after")
    share = (F.col("x") - a["x"]) / (b["x"] - a["x"])
    value = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["x"] == b["x"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)
    looked_up = found.select(F.col("x").alias("_x"), value.alias(name))
    return df.join(looked_up, F.col(score).cast("double") == F.col("_x"), "left").drop("_x")
