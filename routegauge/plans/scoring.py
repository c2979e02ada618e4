"""Answers, metrics and the comparison of modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routegauge import fixed_values as fv
from routegauge.functions import list_metrics as LM
from routegauge.operators import ir_scores, mode_compare, rec_scores
from routegauge.plans.registry import plan, rounded
from routegauge.session import materialise, scratch_path
from routegauge.sources import arrays, ranges, readers, sinks
from routegauge.sources import derived as D

#: What the answers of a request take while they are ranked and scored: some ten, of twenty candidates each.
ANSWER_BYTES = 8192


def _in_both_modes(req: DataFrame) -> DataFrame:
    return req.select("request_id", F.explode(F.array(*[F.lit(m) for m in D.MODES])).alias("mode"))


def _rec_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = D.requests(spark, sf_dir)
    return rec_scores.score_runs(D.rec_runs(req, "truth"), req)


def _rec_tokens(req: DataFrame) -> DataFrame:
    return rec_scores.average_tokens(D.rec_runs(req), _in_both_modes(req))


def rec_wide(spark: SparkSession, sf_dir: str, tokens: bool = False, req: DataFrame | None = None) -> DataFrame:
    """Requests are stored once, or given (``req``), because answers and the list of all requests derive from them.

    A stored file of requests is small, and the answers made from it are not: requests are dealt out again before.
    """
    req = req if req is not None else D.stored_requests(spark, sf_dir)
    dealt = ranges.spread(req.select("request_id", "truth", "candidates"), F.lit(ANSWER_BYTES))
    scored = rec_scores.score_runs(D.rec_runs(dealt, "truth"), req)
    return rec_scores.request_metrics(scored, tokens=tokens, wanted=_in_both_modes(req))


def rec_wide_with_tokens(spark: SparkSession, sf_dir: str, req: DataFrame | None = None) -> DataFrame:
    return rec_wide(spark, sf_dir, tokens=True, req=req)


def rec_pairs(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Both modes of each request side by side, from one pass over the answers."""
    return mode_compare.pair_long(rec_wide_with_tokens(spark, sf_dir), columns)


def _output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, value): the generation record of every request. The requests are stored, since the modes are written one by one."""
    runs = D.rec_runs(D.stored_requests(spark, sf_dir))
    return runs.groupBy("request_id", "mode").agg(
        F.sort_array(F.collect_list(F.struct("run", "text", "num_tokens"))).alias("outputs")
    ).select(
        "mode",
        F.to_json(F.struct(
            F.concat(F.lit("req_"), F.col("request_id").cast("string")).alias("request_id"),
            F.lit("").alias("prompt"),
            F.transform("outputs", lambda o: F.struct(o["text"].alias("text"), o["num_tokens"].alias("num_tokens")))
            .alias("outputs"),
        )).alias("value"),
    )


@plan
def explode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _output_lines(spark, sf_dir)
    return readers.explode_outputs(readers.parse_outputs(lines, keep=["mode"]), keep=["mode"]).drop("prompt")


#: Small ranges, so that files of the test tables are cut as large ones would be.
RANGE_BYTES = 1 << 16


@plan
def outputs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records written as files of one JSON array each, and read back by ranges."""
    lines, path, found = _output_lines(spark, sf_dir), scratch_path(spark, "outputs"), []
    for mode in ("direct", "cot"):
        sinks.write_json_arrays(lines.filter(F.col("mode") == mode), f"{path}/{mode}")
        read = readers.explode_outputs(readers.read_outputs(spark, f"{path}/{mode}", RANGE_BYTES))
        found.append(read.withColumn("mode", F.lit(mode)).drop("prompt"))
    return found[0].unionByName(found[1])


@plan
def token_means_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean tokens of both modes in the order of the requests, through NumPy files."""
    means = materialise(_rec_tokens(D.stored_requests(spark, sf_dir)), "mean-tokens")
    path, found = scratch_path(spark, "means"), []
    for mode in ("direct", "cot"):
        arrays.write_npy(means.filter(F.col("mode") == mode), "request_id", "avg_tokens", f"{path}/{mode}", 1000)
        read = arrays.read_npy(spark, f"{path}/{mode}", 4096)
        found.append(read.select("row", F.lit(mode).alias("mode"), F.get("values", F.lit(0)).alias("avg_tokens")))
    return rounded(found[0].unionByName(found[1]))


@plan
def parse_rec_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec_scores.parse_answers(D.rec_runs(D.requests(spark, sf_dir)))


@plan
def avg_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec_tokens(D.requests(spark, sf_dir)))


@plan
def rec_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _rec_scored(spark, sf_dir)
    none = F.lit(fv.NONE_VALUE)
    return rounded(s.select("request_id", "mode", "run", *[F.coalesce(c, none).alias(c) for c in ("ndcg5", "ndcg10")]))


@plan
def rec_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _rec_scored(spark, sf_dir)
    none = F.lit(fv.NONE_VALUE)
    return rounded(
        s.select("request_id", "mode", "run", *[F.coalesce(c, none).alias(c) for c in ("recall5", "recall10")])
    )


@plan
def rec_metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec_wide(spark, sf_dir))


@plan
def rec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rec_wide_with_tokens(spark, sf_dir).withColumn("split", D.split_of())
    return rounded(rec_scores.summarize(wide, ["mode", "split"]))


@plan
def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run columns arrive under untidy names and some stored averages are NaN."""
    wide = rec_wide(spark, sf_dir)
    untidy = {1: "NDCG10 - 1", 2: "ndcg10 2", 3: "Ndcg10_3", 4: "ndcg104", 5: "ndcg10-5"}
    for i, name in untidy.items():
        wide = wide.withColumnRenamed(f"ndcg10_{i}", name)
    hole = F.when(F.col("request_id") % 50 == 1, F.lit(float("nan"))).otherwise(F.col("avg_ndcg@10"))
    loaded = mode_compare.load_metrics(
        wide.withColumn("avg_ndcg@10", hole), load_recall=True, keys=("request_id", "mode")
    )
    return rounded(loaded.drop("ndcg_runs", "recall_runs"))


@plan
def mode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = mode_compare.load_metrics(rec_wide(spark, sf_dir), load_recall=True, keys=("request_id", "mode"))
    paired = mode_compare.pair_modes(
        loaded.filter(F.col("mode") == "direct"), loaded.filter(F.col("mode") == "cot"), ["mean_ndcg", "mean_recall"]
    )
    return rounded(paired)


@plan
def mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_compare.mode_label(_stable_pairs(spark, sf_dir))


@plan
def oracle_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mode_compare.oracle_mix(_stable_pairs(spark, sf_dir)))


@plan
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mode_compare.win_rates(_stable_pairs(spark, sf_dir)))


def _stable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages rounded to 9 digits, so that equal lists compare equal whatever the summation order."""
    paired = rec_pairs(spark, sf_dir, ["avg_ndcg@10", "avg_tokens"])
    return rounded(paired, 9)


# --- retrieval --------------------------------------------------------------------------------------


def _ir_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sims = D.ir_similarity(spark, sf_dir)
    return D.ir_runs(sims), D.ir_truth(sims)


def _ir_metric(spark, sf_dir, name, fn) -> DataFrame:
    runs, truth = _ir_inputs(spark, sf_dir)
    lists = ir_scores.with_lists(runs, truth)
    return rounded(lists.select("request_id", "mode", "run", fn(F.col("pred"), F.col("truth")).alias(name)))


@plan
def parse_ir_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir_scores.parse_answers(_ir_inputs(spark, sf_dir)[0])


@plan
def ir_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ir_metric(spark, sf_dir, "top1", LM.top1)


@plan
def ir_pairacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ir_metric(spark, sf_dir, "pairacc", LM.pairwise_accuracy)


@plan
def ir_footrule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ir_metric(spark, sf_dir, "footrule", LM.footrule)


@plan
def ir_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ir_metric(spark, sf_dir, "ndcg", lambda p, t: LM.graded_ndcg(p, t, 5))


@plan
def ir_ndcg_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ir_metric(spark, sf_dir, "ndcg", lambda p, t: LM.graded_ndcg(p, t, None, exponential=True))


def ir_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, truth = _ir_inputs(spark, sf_dir)
    return ir_scores.request_metrics(ir_scores.score_runs(runs, truth), n_runs=D.IR_RUNS, wanted=_in_both_modes(truth))


@plan
def ir_metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ir_wide(spark, sf_dir))


@plan
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ir_wide(spark, sf_dir)
    runs, _ = _ir_inputs(spark, sf_dir)
    return rounded(ir_scores.summarize(wide, rec_scores.average_tokens(runs, wide), ["mode"]))
