"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; the last returns one row per
piece with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routegauge.llm.common import read_table, stored
from routegauge.llm.decontamination import drop_leaks
from routegauge.llm.exact_dedup import drop_copies
from routegauge.llm.quality import keep_good
from routegauge.llm.queries_packing import packed
from routegauge.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents whose fingerprints are linked at three bits or fewer, the smallest id."""
    return drop_near_duplicates(docs, width=3, bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenizers, XXH64 fingerprints and fitted models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
