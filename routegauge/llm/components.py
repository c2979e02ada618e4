"""Connected components of an edge table by alternating stars; no node's neighbours are ever gathered into a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hooked(neighbours: DataFrame) -> DataFrame:
    """(a, b, m): every directed edge with the smallest of a and its neighbours. The join lets hot nodes be split."""
    low = neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return neighbours.join(low, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the smallest node of its component.

    ``edges`` has two columns of the same ordered type; loops are ignored, repeated edges and directions do not matter.
    Every round hooks larger neighbours, then all neighbours, to the smallest one; it ends when only stars are left.
    Each round is written to the shared folder, which also cuts the lineage.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "edges")  # every round reads its edges several times
    seen = None
    while True:
        large = _hooked(_both(edges)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = _hooked(large.distinct())
        kept = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.select("a", F.col("m").alias("b")).union(kept).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", F.col("b").alias("root")).distinct()
            )
        seen = state
