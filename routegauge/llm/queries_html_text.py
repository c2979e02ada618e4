"""The query of HTML extraction. SQL has no HTML reader; tests compare with pages whose text is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table
from routegauge.llm.html_text import with_main_text


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: the main text and its length in code points."""
    pages = with_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))
