"""The query of exact deduplication and the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routegauge.llm.common import read_table
from routegauge.llm.exact_dedup import with_groups


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the id that stays of its group of equal texts, the size of the group, and the digest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
  min(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM t
"""
