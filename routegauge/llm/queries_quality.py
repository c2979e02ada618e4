"""The query of the quality classifier; tests measure its accuracy on labelled rows that it did not see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table
from routegauge.llm.quality import expected_good, gumbel_top, importance


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its weight, its place in the Gumbel draw, and whether the draw takes it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = importance(docs, read_table(spark, sf_dir, "labels"))
    drawn = gumbel_top(weights, expected_good(weights))
    return drawn.select(
        F.col("key").alias("doc_id"), "n_grams", "log_weight", (F.col("log_weight") >= 0).cast("int").alias("predicted"),
        "draw", "place", "selected",
    )
