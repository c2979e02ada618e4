"""Yes/no checklist features from hidden vectors of the probe."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegauge.functions import matrices as M

TOP = 3


def verbalizer_sets(tokens: DataFrame) -> DataFrame:
    """set, side, token_ids: distinct first tokens in variant order; a set needs both sides, and one set must remain."""
    ids = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("variant_no", "token_id"))), lambda s: s["token_id"]))
    sides = tokens.groupBy("set").agg(F.count_if(F.col("side") == "yes").alias("y"), F.count_if(F.col("side") == "no").alias("n"))
    whole = sides.filter((F.col("y") > 0) & (F.col("n") > 0)).select("set")
    some = whole.agg(F.count(F.lit(1))).scalar()
    checked = F.when(some > 0, F.col("set")).otherwise(F.raise_error(F.lit("every verbalizer set lacks a side")).cast("string"))
    return tokens.groupBy("set", "side").agg(ids.alias("token_ids")).join(whole, "set", "left_semi").select(
        checked.alias("set"), "side", "token_ids"
    )


def margins(hidden: DataFrame, weights: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add ``margins`` (one per set, in the returned order) to rows with vec.

    The weights are the output rows of a handful of verbalizer tokens; they travel with the function.
    """
    rows = weights.collect()  # a few rows per set
    names = sorted({r["set"] for r in rows})
    if not names:
        raise ValueError("every verbalizer set lacks a side")
    matrix = np.array([r["w"] for r in rows], dtype=np.float64)
    bias = np.array([r["b"] or 0.0 for r in rows], dtype=np.float64)

    def places(side: str) -> list[list[int]]:
        return [[i for i, r in enumerate(rows) if r["set"] == n and r["side"] == side] for n in names]

    fn = M.margins_function(matrix, bias, places("yes"), places("no"))
    return hidden.withColumn("margins", fn("vec")).drop("vec"), names


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def question_features(probed: DataFrame) -> DataFrame:
    """request_id, q, p_dir, p_cot, margin, margin_raw, after subtracting the neutral margins (q = 0) per set."""
    neutral = probed.filter(F.col("q") == 0).select("request_id", F.col("margins").alias("bias"))
    asked = probed.filter(F.col("q") > 0).join(neutral, "request_id")
    corrected = asked.withColumn("m", F.zip_with("margins", "bias", lambda a, b: a - b))
    sides = corrected.select(
        "request_id", "q", "side",
        _mean(F.transform("m", lambda x: 1.0 / (1.0 + F.exp(-x)))).alias("p"),
        _mean(F.col("m")).alias("raw"),
    )

    def of(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))

    wide = sides.groupBy("request_id", "q").agg(
        of("dir", "p").alias("p_dir"), of("cot", "p").alias("p_cot"), (of("dir", "raw") - of("cot", "raw")).alias("margin_raw")
    )
    return wide.withColumn("margin", F.col("p_dir") - F.col("p_cot"))


def aggregates(questions: DataFrame) -> DataFrame:
    """Per request means, wins, and the mean of the three raw margins largest in absolute value."""
    ranked = F.sort_array(F.collect_list(F.struct(F.abs("margin_raw").alias("a"), "q", "margin_raw")), asc=False)
    table = questions.groupBy("request_id").agg(
        F.avg("p_dir").alias("dir_mean"),
        F.avg("p_cot").alias("cot_mean"),
        F.avg("margin_raw").alias("margin_mean_raw"),
        F.count_if(F.col("margin_raw") > 0).cast("double").alias("win_count"),
        F.slice(ranked, 1, TOP).alias("top"),
    )
    return table.select(
        "request_id", "dir_mean", "cot_mean", (F.col("dir_mean") - F.col("cot_mean")).alias("gap_mean"), "margin_mean_raw",
        "win_count", _mean(F.transform("top", lambda s: s["margin_raw"])).alias("top3_margin_mean"),
    )


def select_margins(questions: DataFrame, given: DataFrame, prefix: str = "mraw", topk: int = TOP) -> DataFrame:
    """Raw margins of all questions seen anywhere as columns, plus the aggregates.

    An aggregate present in ``given`` is kept; an absent one is recomputed, where the top margin is the
    mean of the ``topk`` smallest ones and a request without margins has win_count 0.
    """
    questions = questions.filter(F.col("margin_raw").isNotNull())
    seen = [r["q"] for r in questions.select("q").distinct().orderBy("q").collect()]  # question numbers
    lowest = F.slice(F.sort_array(F.collect_list("margin_raw")), 1, max(1, topk))
    table = questions.groupBy("request_id").agg(
        *[F.max(F.when(F.col("q") == q, F.col("margin_raw"))).alias(f"{prefix}_q{q}") for q in seen],
        F.avg("margin_raw").alias("_mean"),
        F.count_if(F.col("margin_raw") > 0).cast("double").alias("_wins"),
        lowest.alias("_low"),
        F.avg("p_dir").alias("_dir"),
        F.avg("p_cot").alias("_cot"),
    )
    joined = given.select("request_id", "margin_mean_raw", "win_count", "top3_margin_mean", "gap_mean").join(
        table, "request_id", "full"
    )
    smallest = F.when(F.size("_low") > 0, F.try_divide(F.aggregate("_low", F.lit(0.0), lambda s, x: s + x), F.size("_low")))
    return joined.select(
        "request_id",
        *[f"{prefix}_q{q}" for q in seen],
        F.coalesce("margin_mean_raw", "_mean").alias("margin_mean_raw"),
        F.coalesce("win_count", "_wins", F.lit(0.0)).alias("win_count"),
        F.coalesce("top3_margin_mean", smallest).alias("top3_margin_mean"),
        F.coalesce("gap_mean", F.col("_dir") - F.col("_cot")).alias("gap_mean"),
    )
