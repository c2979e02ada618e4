"""The query of line deduplication; tests compare it with all pairs of a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table
from routegauge.llm.line_dedup import with_line_report


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, those that repeat an earlier line exactly or nearly, and the lines they repeat."""
    found = with_line_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    heads = F.transform("repeats", lambda x: F.concat_ws(":", x["no"], x["head_id"], x["head_no"], x["variants"]))
    return found.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.concat_ws(",", "dropped").alias("dropped_lines"),
        F.concat_ws(",", heads).alias("dropped_heads"),
    )
