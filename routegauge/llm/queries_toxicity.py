"""The query of toxicity scores; tests measure them on held-out labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table
from routegauge.llm.toxicity import score


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its toxicity score and whether its label was held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, read_table(spark, sf_dir, "labels"), learn=~held_out(F.col("label_id")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio", "expression"
    )
