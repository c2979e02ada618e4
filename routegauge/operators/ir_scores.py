"""Retrieval answers to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.functions import list_metrics as LM
from routegauge.functions.answers import bracket_ids, ir_ids

KEYS = ("request_id", "mode")


def parse_answers(runs: DataFrame) -> DataFrame:
    """request_id, mode, run, pos, passage."""
    ids = runs.select(*KEYS, "run", ir_ids(F.col("text")).alias("ids"))
    # of the plain form Spark infers a filter on the ids, which would parse every answer again
    return ids.select(*KEYS, "run", F.posexplode_outer("ids").alias("pos", "passage")).filter(F.col("pos").isNotNull())


def with_lists(runs: DataFrame, truth: DataFrame) -> DataFrame:
    parsed = runs.select(*KEYS, "run", ir_ids(F.col("text")).alias("pred"))
    order = truth.select("request_id", bracket_ids(F.col("ground_truth")).alias("truth"))
    return parsed.join(order, "request_id")


def score_runs(runs: DataFrame, truth: DataFrame, ks=(5, 10)) -> DataFrame:
    """Per run metrics; a run without ids scores 0 everywhere."""
    pred, order = F.col("pred"), F.col("truth")
    return with_lists(runs, truth).select(
        *KEYS,
        "run",
        *[LM.graded_ndcg(pred, order, k).alias(f"ndcg{k}") for k in ks],
        LM.pairwise_accuracy(pred, order).alias("pairacc"),
        LM.top1(pred, order).alias("top1"),
        LM.footrule(pred, order).alias("spearmanF"),
    )


def request_metrics(
    scored: DataFrame, ks=(5, 10), n_runs: int | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """Wide table, run columns up to the largest run number anywhere, missing runs 0.

    Without ``n_runs`` that number is looked up first, which runs a one-row aggregate. Every (request_id, mode) of
    ``wanted`` has a row, all 0 where it has no run.
    """
    if n_runs is None:
        n_runs = scored.agg(F.max("run")).first()[0] or 0
    if wanted is not None:
        scored = scored.unionByName(wanted.select(*KEYS), allowMissingColumns=True)

    def mean(column: str, name: str):
        return F.coalesce(F.avg(column), F.lit(0.0)).alias(name)

    cells = [
        F.coalesce(F.max(F.when(F.col("run") == i, F.col("ndcg10"))), F.lit(0.0)).alias(f"ndcg10_{i}")
        for i in range(1, n_runs + 1)
    ]
    return scored.groupBy(*KEYS).agg(
        *[mean(f"ndcg{k}", f"avg_ndcg@{k}") for k in ks],
        mean("pairacc", "avg_pairacc"),
        mean("top1", "avg_top1"),
        mean("spearmanF", "avg_spearmanF"),
        *cells,
    )


def summarize(metrics: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    cols = [c for c in metrics.columns if c not in KEYS and c not in by]
    return metrics.join(tokens, list(KEYS)).groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in cols], F.avg("avg_tokens").alias("avg_tokens")
    )
