"""The query of best-fit packing. SQL has no tokenizer; tests check round trips and the plan."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table, stored
from routegauge.llm.packing import place, tokenised

TOKENIZER = "byte_bpe_50k.json"


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places and the CRC-32 of their ids; ids themselves are not shuffled."""
    pieces = tokenised(docs, tokenizer or public_tokenizers.path(TOKENIZER))
    pieces = stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return place(pieces, ["doc_id", "piece", "ids_crc32", "start"])


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: where its document was cut, and its sequence and place there."""
    return packed(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
