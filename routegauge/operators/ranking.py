"""Exact ranks, prefix sums and quantiles over tables of any size, without a one-task window.

Rows are range-partitioned on the wanted order and materialised once, so that every later pass sees the
same ranges. Positions then follow from per-partition counts, a table of one row per partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _sorted_segments(df: DataFrame, order: list[Column], by: tuple[str, ...]) -> DataFrame:
    cols = [F.col(b) for b in by] + list(order)
    laid_out = cut_lineage(df.repartitionByRange(*cols).sortWithinPartitions(*cols))
    row = F.monotonically_increasing_id()
    return laid_out.withColumn("_row", row).withColumns(
        {"_part": F.shiftright("_row", _ROW_BITS), "_at": F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )


def _offsets(segments: DataFrame, by: tuple[str, ...], sums: dict[str, str]) -> DataFrame:
    per = segments.groupBy(*by, "_part").agg(
        F.min("_at").alias("_first"),
        F.count(F.lit(1)).alias("_len"),
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()],
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *by,
        "_part",
        "_first",
        F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_skip"),
        F.sum("_len").over(group).alias("_size"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0.0)).alias(f"_skip_{n}") for n in sums],
    )


def with_rank(
    df: DataFrame, order: list[Column], by: tuple[str, ...] = (), sums: dict[str, str] | None = None,
    rank: str = "rn", size: str = "n",
) -> DataFrame:
    """Add the 1-based rank, the group size and inclusive running sums {new column: summed column}.

    The order must be total (end it with a unique key) for the ranks to be reproducible.
    """
    sums = sums or {}
    segments = _sorted_segments(df, order, by)
    offsets = _offsets(segments, by, sums)
    if not by:
        offsets = F.broadcast(offsets)  # one row per partition
    joined = segments.join(offsets, [*by, "_part"])
    within = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        (F.col("_skip") + F.col("_at") - F.col("_first") + 1).alias(rank),
        F.col("_size").alias(size),
        *[(F.col(f"_skip_{n}") + F.sum(c).over(within)).alias(n) for n, c in sums.items()],
    )


def interpolated(ranked: DataFrame, value: str, prob: Column | float, ascending: bool = True) -> tuple[Column, Column, Column]:
    """Aggregates (low value, high value, fraction) of the linearly interpolated quantile of a ranked table."""
    q = prob if isinstance(prob, Column) else F.lit(float(prob))
    at = (F.col("n") - 1) * q
    low = F.floor(at)
    place = F.col("rn") - 1 if ascending else F.col("n") - F.col("rn")
    lo = F.max(F.when(place == low, F.col(value)))
    hi = F.max(F.when(place == F.least(low + 1, F.col("n") - 1), F.col(value)))
    return lo, hi, F.max(at - low)


def lerp(lo: Column, hi: Column, t: Column) -> Column:
    return F.when(t < 0.5, lo + (hi - lo) * t).otherwise(hi - (hi - lo) * (1.0 - t))


def quantiles(
    df: DataFrame, value: str, tie: str, probs: dict[str, float], by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per group with exact, linearly interpolated quantiles {column: probability} and the size n."""
    ranked = with_rank(df.select(*by, value, tie), [F.col(value), F.col(tie)], by)
    aggs = []
    for name, p in probs.items():
        lo, hi, t = interpolated(ranked, value, p)
        aggs += [lo.alias(f"_lo_{name}"), hi.alias(f"_hi_{name}"), t.alias(f"_t_{name}")]
    table = ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    return table.select(
        *by, "n", *[lerp(F.col(f"_lo_{q}"), F.col(f"_hi_{q}"), F.col(f"_t_{q}")).alias(q) for q in probs]
    )
