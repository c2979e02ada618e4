"""The query of token counts. SQL has no tokenizer; tests compare with the library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table
from routegauge.llm.prefix_counts import with_budgets

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its bytes and tokens, whether it passes the limit, and how much of it lies within."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_budgets(docs, public_tokenizers.path(TOKENIZER), LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "kept_chars")
