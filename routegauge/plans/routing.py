"""Labels, splits, policies and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.functions.hashing import unit
from routegauge.operators import labels as L
from routegauge.operators import policies as P
from routegauge.operators.mode_compare import pair_long
from routegauge.operators.ranking import with_rank
from routegauge.plans.registry import plan, rounded
from routegauge.plans.scoring import rec_wide, rec_wide_with_tokens
from routegauge.session import materialise
from routegauge.sources import derived as D

BUDGETS = 11


def run_values() -> Column:
    """The five run columns, a failed or missing run counting as 0."""
    cells = [F.col(f"ndcg10_{i}") for i in range(1, fv.K_RUNS + 1)]
    return F.array(*[F.when(c == fv.NONE_VALUE, F.lit(0.0)).otherwise(c) for c in cells])


def mode_statistics(spark: SparkSession, sf_dir: str, req: DataFrame | None = None) -> DataFrame:
    """Both modes per request: mean and variance over the run columns, mean tokens; stored with 9 digits."""
    stats = rec_wide_with_tokens(spark, sf_dir, req).withColumn("runs", run_values())
    return stats.select(
        "request_id", "mode",
        F.round(L.trimmed_mean(F.col("runs")), 9).alias("mu"),
        F.round(L.population_variance(F.col("runs")), 9).alias("var"),
        F.round("avg_tokens", 9).alias("tok"),
    )


def core(spark: SparkSession, sf_dir: str, req: DataFrame | None = None) -> DataFrame:
    """request_id, split, mu_d, mu_c, var_d, var_c, tok_d, tok_c, advantage, weight, score (ties included).

    Stored, because ranges are sampled before they are sorted, and sampling would score every answer again.
    """
    paired = pair_long(mode_statistics(spark, sf_dir, req), ["mu", "var", "tok"])
    renamed = paired.select(
        "request_id",
        D.split_of().alias("split"),
        *[F.col(f"{m}_{c}").alias(f"{c}_{m[0]}") for c in ("mu", "var", "tok") for m in ("direct", "cot")],
    )
    labelled = L.advantage(renamed).withColumn("advantage", F.round("advantage", 9))
    noisy = F.col("advantage") + F.lit(0.3) * (unit("request_id", F.lit("score")) - F.lit(0.5))
    return materialise(labelled.withColumn("score", F.round(noisy, 3)), "scored-requests")


def split_core(spark: SparkSession, sf_dir: str, req: DataFrame | None = None) -> DataFrame:
    return L.split_train_dev(core(spark, sf_dir, req))


def _is(split: str) -> Column:
    return F.col("split") == split


def better_mode(dev: DataFrame) -> str:
    row = dev.agg(F.round(F.avg("mu_c"), P.STABLE).alias("c"), F.round(F.avg("mu_d"), P.STABLE).alias("d")).first()
    return "cot" if row["c"] >= row["d"] else "direct"


def signed_ranks(scored: DataFrame) -> tuple[DataFrame, str]:
    """Ranks per split by the score of the better dev mode, which is negated when direct is better."""
    mode = better_mode(scored.filter(_is("dev")))
    signed = F.col("score") if mode == "cot" else -F.col("score")
    return with_rank(scored.withColumn("signed", signed), P.by_score("signed"), by=("split",)), mode


def dev_curve(ranked: DataFrame, mode: str) -> DataFrame:
    cot, direct = ("mu_c", "tok_c"), ("mu_d", "tok_d")
    pos, neg = (cot, direct) if mode == "cot" else (direct, cot)
    return P.rate_curve(ranked.filter(_is("dev")), P.RateGrid(), pos, neg)


def choose_policies(ranked: DataFrame, mode: str, epsilon_delta: float = 0.0) -> dict[str, dict]:
    """Top-r, Knee, Utopia and, where reachable, Epsilon from the dev curve (at most 101 rows reach the driver)."""
    spark = ranked.sparkSession
    dev = ranked.filter(_is("dev"))
    measured = dev_curve(ranked, mode)
    points = measured.collect()
    curve = spark.createDataFrame(points, measured.schema).coalesce(1)  # a few windows over at most 101 rows
    best = min(points, key=lambda p: (-p["mean_ndcg"], p["point"]))
    base = P.tau_for_rate(dev, best["rate"], "signed", F.avg("mu_c").alias("c"), F.avg("mu_d").alias("d")).first()
    target = round(max(base["c"], base["d"]), P.STABLE) + epsilon_delta
    front = P.pareto_front(curve)
    picks = P.select_knee(front).unionByName(P.select_utopia(front)).unionByName(P.select_epsilon(front, target))
    out = {"Top-r": {"name": "top_r_tau", "r": best["rate"], "tau": base["tau"], "positive_mode": mode}}
    for row in picks.collect():  # at most three rows
        out[row["selector"].capitalize()] = {
            "name": "budget_topr_point", "rate": row["rate"], "target_mean_tokens": row["mean_tokens"],
            "positive_mode": mode,
        }
    return out


def reports(ranked: DataFrame, policies: dict[str, dict]) -> DataFrame:
    held_out = ranked.filter(F.col("split").isin("dev", "test"))
    assigned = P.spread_policies(held_out, {n: P.apply_symmetric(p) for n, p in policies.items()})
    return P.evaluate(assigned, ["policy", "split"])


def budget_targets(scored: DataFrame, points: int = BUDGETS) -> list[float]:
    """Evenly spaced between the mean tokens of the two modes."""
    row = scored.agg(F.round(F.avg("tok_d"), 6).alias("d"), F.round(F.avg("tok_c"), 6).alias("c")).first()
    return [round(row["d"] + (row["c"] - row["d"]) * i / (points - 1), 9) for i in range(points)]


# --- labels -----------------------------------------------------------------------------------------


@plan
def trimmed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rec_wide(spark, sf_dir)
    return rounded(
        wide.withColumn("runs", run_values()).select(
            "request_id", "mode",
            L.trimmed_mean(F.col("runs")).alias("mean_trim10"),
            L.trimmed_mean(F.col("runs"), 0.25).alias("mean_trim25"),
            L.population_variance(F.col("runs")).alias("variance"),
        )
    )


@plan
def split_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = materialise(D.requests(spark, sf_dir).select("request_id", D.split_of().alias("split")), "splits")
    return L.split_train_dev(req).select("request_id", "split")


@plan
def advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core(spark, sf_dir).select("request_id", "split", "advantage", "weight"))


@plan
def rank_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_core(spark, sf_dir).filter(_is("train"))
    row = L.rank_thresholds(train)
    graded = row.select("thresholds", F.posexplode("gains").alias("grade", "gain"))
    return rounded(graded.select(
        "grade", "gain", F.get("thresholds", F.col("grade") - 2).alias("threshold")
    ))


@plan
def rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = split_core(spark, sf_dir)
    cuts = L.rank_thresholds(scored.filter(_is("train")))
    return L.rank_labels(scored, cuts).select("request_id", "split", "grade")


# --- policies ---------------------------------------------------------------------------------------


@plan
def eval_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = split_core(spark, sf_dir).withColumn("pred", (F.col("score") > 0).cast("int"))
    return rounded(P.evaluate(scored, ["split"]))


@plan
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.baselines(split_core(spark, sf_dir), ["split"]))


@plan
def tau_top_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(core(spark, sf_dir), P.by_score())
    rows = [P.tau_for_rate(ranked, r).withColumn("rate", F.lit(r)) for r in (0.0, 0.13, 0.25, 0.5, 1.0)]
    return rounded(reduce(DataFrame.unionByName, rows))


@plan
def apply_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = core(spark, sf_dir)
    s = F.col("score")
    return scored.select(
        "request_id",
        P.apply_policy(s, {"name": "equivalence_tau", "tau": 0.05}).alias("pred_tau"),
        P.apply_policy(s, {"name": "budget_density", "eta": 0.0002}).alias("pred_density"),
    )


@plan
def top_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(core(spark, sf_dir), P.by_score())
    return ranked.select(
        "request_id", "rn", *[P.top_rate_policy(r).alias(f"pred_{int(r * 100)}") for r in (0.0, 0.25, 0.5)]
    )


@plan
def rate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.rate_curve(with_rank(core(spark, sf_dir), P.by_score()), P.RateGrid()))


@plan
def refine_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(core(spark, sf_dir), P.by_score())
    coarse = P.best_point(P.rate_curve(ranked, P.RateGrid())).first()  # one row
    return rounded(P.best_point(P.rate_curve(ranked, P.RateGrid.around(coarse["rate"]))))


@plan
def min_rate_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(core(spark, sf_dir), P.by_score())
    base = ranked.agg(F.avg("mu_c").alias("c"), F.avg("mu_d").alias("d")).first()
    target = round(max(base["c"], base["d"]), 6)
    return rounded(P.smallest_rate_reaching(P.rate_curve(ranked, P.RateGrid()), target))


@plan
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = core(spark, sf_dir)
    middle = budget_targets(scored)[BUDGETS // 2]
    return rounded(P.budget_curve(scored, [middle]))


@plan
def budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = core(spark, sf_dir)
    return rounded(P.budget_curve(scored, budget_targets(scored)))


@plan
def eta_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = core(spark, sf_dir)
    return rounded(P.eta_for_budgets(scored, budget_targets(scored)[1::4]).select("eta", "target"), 9)


@plan
def rebuild_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = split_core(spark, sf_dir)
    target = budget_targets(scored.filter(_is("dev")))[BUDGETS // 2]
    test = scored.filter(_is("test"))
    policy = P.rebuild_budget_policy({"target_mean_tokens": target}, test)
    report = P.evaluate(test.withColumn("pred", P.apply_policy(F.col("score"), policy)))
    return rounded(report.withColumn("eta", F.lit(policy["eta"])).withColumn("target", F.lit(target)), 9)


def _front(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ranked, mode = signed_ranks(split_core(spark, sf_dir))
    return P.pareto_front(dev_curve(ranked, mode)), ranked


@plan
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_front(spark, sf_dir)[0].select("idx", "rate", "mean_ndcg", "mean_tokens"))


@plan
def knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = P.select_knee(_front(spark, sf_dir)[0])
    return rounded(chosen.select("selector", "idx", "rate", "mean_ndcg", "mean_tokens"))


@plan
def utopia(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = P.select_utopia(_front(spark, sf_dir)[0])
    return rounded(chosen.select("selector", "idx", "rate", "mean_ndcg", "mean_tokens"))


@plan
def epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    front, ranked = _front(spark, sf_dir)
    base = ranked.filter(_is("dev")).agg(F.avg("mu_c").alias("c"), F.avg("mu_d").alias("d")).first()
    chosen = P.select_epsilon(front, round(max(base["c"], base["d"]), 6))
    return rounded(chosen.select("selector", "idx", "rate", "mean_ndcg", "mean_tokens"))


@plan
def apply_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, mode = signed_ranks(split_core(spark, sf_dir))
    chosen = choose_policies(ranked, mode)
    return ranked.filter(F.col("split").isin("dev", "test")).select(
        "request_id", "split",
        P.apply_symmetric(chosen["Top-r"]).alias("pred_topr"),
        P.apply_symmetric(chosen["Utopia"]).alias("pred_utopia"),
    )


@plan
def policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, mode = signed_ranks(split_core(spark, sf_dir))
    return rounded(reports(ranked, choose_policies(ranked, mode)))


@plan
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, mode = signed_ranks(split_core(spark, sf_dir))
    chosen = choose_policies(ranked, mode)
    predictions = ranked.filter(_is("test")).select(
        "request_id",
        P.apply_symmetric(chosen["Top-r"]).alias("pred_topr"),
        P.apply_symmetric(chosen["Utopia"]).alias("pred_utopia"),
        P.apply_symmetric({"name": "none"}).alias("pred_none"),
    )
    names = ["avg_recall@5", "avg_ndcg@5", "avg_recall@10", "avg_ndcg@10", "avg_tokens"]
    paired = pair_long(rec_wide_with_tokens(spark, sf_dir), names)
    return rounded(P.policy_metrics(predictions, paired, names))


@plan
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy report: baselines, selected parameters and the reports of every policy."""
    ranked, mode = signed_ranks(split_core(spark, sf_dir))
    chosen = choose_policies(ranked, mode)
    measures = ["mean_ndcg", "mean_tokens", "total_tokens", "utility", "cot_rate"]
    held_out = ranked.filter(F.col("split").isin("dev", "test"))
    base = P.baselines(held_out, ["split"]).withColumn("section", F.concat(F.col("split"), F.lit(" baselines")))
    rep = reports(ranked, chosen).withColumn("section", F.concat(F.col("split"), F.lit(" reports")))
    tidy = base.unionByName(rep).unpivot(["section", "policy"], measures, "metric", "value")
    params = [
        ("params", name, key, float(p[key])) for name, p in chosen.items() for key in ("r", "tau", "rate", "target_mean_tokens")
        if key in p
    ]
    selected = spark.createDataFrame(params, "section string, policy string, metric string, value double")
    return rounded(tidy.select("section", "policy", "metric", "value").unionByName(selected))
