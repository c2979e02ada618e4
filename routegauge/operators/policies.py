"""Routing policies: evaluation, rate sweeps, token budgets, and the choice of a point on the front.

Scored tables carry request_id, score, mu_d, mu_c (quality) and tok_d, tok_c (tokens) of both modes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.operators.ranking import interpolated, lerp, with_rank
from routegauge.session import cut_lineage, ship_package

TINY = 1e-12
SLACK = 1e-9
STABLE = 12  # digits that decide ties between means


def by_score(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("request_id")]


def report_columns(pred: Column, lambda_cost: float = fv.LAMBDA_COST) -> list[Column]:
    """Aggregates of a 0/1 assignment (1 = step-by-step)."""
    ndcg = F.when(pred == 1, F.col("mu_c")).otherwise(F.col("mu_d"))
    tokens = F.when(pred == 1, F.col("tok_c")).otherwise(F.col("tok_d"))
    return [
        F.avg(ndcg).alias("mean_ndcg"),
        F.avg(tokens).alias("mean_tokens"),
        F.sum(tokens).alias("total_tokens"),
        (F.avg(ndcg) - F.lit(float(lambda_cost)) * (F.avg(tokens) / 1000.0)).alias("utility"),
        F.avg(pred.cast("double")).alias("cot_rate"),
    ]


def evaluate(assigned: DataFrame, by: list[str] = (), lambda_cost: float = fv.LAMBDA_COST) -> DataFrame:
    """Report of the column ``pred`` for each group."""
    return assigned.groupBy(*by).agg(*report_columns(F.col("pred"), lambda_cost))


def spread_policies(df: DataFrame, assignments: dict[str, Column]) -> DataFrame:
    """One row per request and policy, so that all policies are evaluated in a single aggregate."""
    pairs = F.array(*[F.struct(F.lit(n).alias("policy"), p.cast("int").alias("pred")) for n, p in assignments.items()])
    return df.withColumn("_p", F.explode(pairs)).select("*", "_p.policy", "_p.pred").drop("_p")


def baselines(df: DataFrame, by: list[str] = (), lambda_cost: float = fv.LAMBDA_COST) -> DataFrame:
    both = spread_policies(df, {"Always-Direct": F.lit(0), "Always-CoT": F.lit(1)})
    return evaluate(both, ["policy", *by], lambda_cost)


def tau_for_rate(ranked: DataFrame, rate: float, score: str = "score", *beside: Column) -> DataFrame:
    """One row ``tau``, the (1 - rate) quantile of a table ranked by descending score, and the aggregates ``beside`` it."""
    lo, hi, t = interpolated(ranked, score, 1.0 - rate, ascending=False)
    found = ranked.agg(lo.alias("lo"), hi.alias("hi"), t.alias("t"), *beside)
    return found.withColumn("tau", lerp(F.col("lo"), F.col("hi"), F.col("t"))).drop("lo", "hi", "t")


def threshold_policy(score: Column, tau: float) -> Column:
    return (score >= F.lit(float(tau))).cast("int")


def density_policy(score: Column, eta: float) -> Column:
    delta = F.col("tok_c") - F.col("tok_d")
    free = (delta <= 0) & (score > 0)
    return (free | (score / F.greatest(delta, F.lit(TINY)) >= F.lit(float(eta)))).cast("int")


def apply_policy(score: Column, policy: dict) -> Column:
    if policy["name"] in ("top_r_tau", "equivalence_tau"):
        return threshold_policy(score, policy["tau"])
    if policy["name"] == "budget_density":
        return density_policy(score, policy["eta"])
    raise ValueError(f"no rule for policy {policy['name']!r}")


def rate_cut(n: Column, rate: Column | float) -> Column:
    """round(rate * n), half to even."""
    return F.bround((rate if isinstance(rate, Column) else F.lit(float(rate))) * n).cast("bigint")


def top_rate_policy(rate: float) -> Column:
    """First round(rate * n) rows of a table with rank rn and size n."""
    return (F.col("rn") <= rate_cut(F.col("n"), rate)).cast("int")


# --- sweeps over rates ------------------------------------------------------------------------------


class RateGrid:
    """Rates start + i * step for i below count."""

    def __init__(self, start: float = 0.0, step: float = 0.01, count: int = 101):
        self.start, self.step, self.count = start, step, count

    @classmethod
    def around(cls, centre: float, width: float = 0.05, step: float = 0.002) -> RateGrid:
        low, high = max(0.0, centre - width), min(1.0, centre + width)
        return cls(low, step, math.ceil((high + TINY - low) / step))

    def rate(self, i: Column) -> Column:
        return F.lit(self.start) + i * F.lit(self.step)


def rate_curve(
    ranked: DataFrame, grid: RateGrid, pos: tuple[str, str] = ("mu_c", "tok_c"), neg: tuple[str, str] = ("mu_d", "tok_d"),
    lambda_cost: float = fv.LAMBDA_COST,
) -> DataFrame:
    """Quality and cost for every rate of the grid, from one aggregate over the ranked rows.

    A row joins the selection at the first grid point whose cut reaches its rank, so the curve is the
    running total of one sum per grid point.
    """
    n, rn = F.col("n"), F.col("rn")
    guess = F.ceil(((rn - F.lit(0.5)) / n - F.lit(grid.start)) / F.lit(grid.step))

    near = [F.greatest(guess + step, F.lit(0).cast("bigint")) for step in (-1, 0, 1)]
    entry = F.coalesce(*[F.when(rate_cut(n, grid.rate(i)) >= rn, i) for i in near])
    last = F.lit(grid.count).cast("bigint")
    sums = ranked.groupBy(F.least(F.coalesce(entry, last), last).alias("i")).agg(
        F.sum(F.col(pos[0]) - F.col(neg[0])).alias("d_ndcg"),
        F.sum(F.col(pos[1]) - F.col(neg[1])).alias("d_tokens"),
        F.sum(neg[0]).alias("b_ndcg"),
        F.sum(neg[1]).alias("b_tokens"),
        F.count(F.lit(1)).alias("rows"),
    )
    points = ranked.sparkSession.range(grid.count + 1).withColumnRenamed("id", "i")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # count + 1 rows
    zero = F.lit(0.0)
    curve = points.join(F.broadcast(sums), "i", "left").select(
        "i",
        F.sum("rows").over(everything).alias("n"),
        F.sum(F.coalesce("d_ndcg", zero)).over(upto).alias("d_ndcg"),
        F.sum(F.coalesce("d_tokens", zero)).over(upto).alias("d_tokens"),
        F.sum("b_ndcg").over(everything).alias("b_ndcg"),
        F.sum("b_tokens").over(everything).alias("b_tokens"),
    )
    mean_ndcg = (F.col("b_ndcg") + F.col("d_ndcg")) / F.col("n")
    mean_tokens = (F.col("b_tokens") + F.col("d_tokens")) / F.col("n")
    rate = grid.rate(F.col("i"))
    return curve.filter(F.col("i") < grid.count).select(
        F.col("i").alias("point"),
        rate.alias("rate"),
        rate_cut(F.col("n"), rate).alias("k"),
        F.round(mean_ndcg, STABLE).alias("mean_ndcg"),
        F.round(mean_tokens, STABLE).alias("mean_tokens"),
        (F.col("b_tokens") + F.col("d_tokens")).alias("total_tokens"),
        (mean_ndcg - F.lit(float(lambda_cost)) * (mean_tokens / 1000.0)).alias("utility"),
        (rate_cut(F.col("n"), rate) / F.col("n")).alias("cot_rate"),
    )


def best_point(curve: DataFrame) -> DataFrame:
    """Highest quality, first rate on ties."""
    return curve.orderBy(F.desc("mean_ndcg"), "point").limit(1)


def smallest_rate_reaching(curve: DataFrame, target: float) -> DataFrame:
    return curve.filter(F.col("mean_ndcg") >= target - TINY).orderBy("point").limit(1)


# --- the front of a curve (at most one row per grid point) ------------------------------------------


def pareto_front(curve: DataFrame) -> DataFrame:
    """Cheapest first; each kept point beats all cheaper ones. ``idx`` numbers the front from 0."""
    order = [F.asc("mean_tokens"), F.asc("point")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.coalesce(F.max("mean_ndcg").over(before), F.lit(-1.0))
    front = curve.withColumn("_best", best_before).filter(F.col("mean_ndcg") > F.col("_best") + TINY).drop("_best")
    return front.withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)


def _normalised(front: DataFrame) -> DataFrame:
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(everything), F.max(c).over(everything)
        return (F.col(c) - low) / F.greatest(high - low, F.lit(TINY))

    return front.select("*", (1.0 - scaled("mean_tokens")).alias("_cheap"), scaled("mean_ndcg").alias("_good"))


def _pick(front: DataFrame, cost: Column, selector: str) -> DataFrame:
    chosen = _normalised(front).withColumn("_cost", F.round(cost, STABLE)).orderBy("_cost", "idx").limit(1)
    return chosen.drop("_cost", "_cheap", "_good").withColumn("selector", F.lit(selector))


def select_knee(front: DataFrame) -> DataFrame:
    """Farthest from the diagonal; the first point wins ties, which makes this the cheapest point."""
    return _pick(front, -F.abs(F.col("_good") - F.col("_cheap")) / math.sqrt(2.0), "knee")


def select_utopia(front: DataFrame, w_ndcg: float = 1.0, w_tokens: float = 1.0) -> DataFrame:
    """Closest to best quality at lowest cost."""
    cheap, good = F.lit(1.0) - F.col("_cheap"), F.lit(1.0) - F.col("_good")
    return _pick(front, F.sqrt(F.lit(float(w_tokens)) * cheap * cheap + F.lit(float(w_ndcg)) * good * good), "utopia")


def select_epsilon(front: DataFrame, target: float) -> DataFrame:
    """Cheapest point that reaches the target; no row when none does."""
    reached = front.filter(F.col("mean_ndcg") >= target - TINY).orderBy("mean_tokens", "idx").limit(1)
    return reached.withColumn("selector", F.lit("epsilon"))


# --- token budgets ----------------------------------------------------------------------------------


def _small(items: pa.RecordBatch, after: int, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, delta, small): items behind the last event, and which of them take at most half of the room."""
    place, delta = items.column(0).to_numpy(), items.column(1).to_numpy()
    asked = place > after
    return asked, delta, asked & (delta <= room / 2)


def _part_sums(state: list[tuple[int, int, float]]):
    """(part, b, small): the tokens of small items of every range and budget."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), np.zeros(len(state))
        for batch in batches:
            for i, (_, after, room) in enumerate(state):
                _, delta, small = _small(batch, after, room)
                sums[i] += delta[small].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(state), pa.int32()), pa.array([b for b, _, _ in state], pa.int32()), pa.array(sums)], names=["part", "b", "small"]
        )

    return apply


def _part_events(state: list[tuple[int, int, float]], before: dict[tuple[int, int], float]):
    """(part, b, event, selected, tokens, ndcg) of what every range would take, up to its own first event."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found = [[None, 0, 0.0, 0.0] for _ in state]
        used = [before.get((part, b), 0.0) for b, _, _ in state]
        for batch in batches:
            place, gain = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, (_, after, room) in enumerate(state):
                if found[i][0] is not None:
                    continue
                asked, delta, small = _small(batch, after, room)
                upto = used[i] + np.cumsum(np.where(small, delta, 0.0))
                event = asked & np.where(small, upto > room / 2, upto + delta <= room)
                at = np.flatnonzero(event)[:1]
                taken = small.copy()
                if len(at):
                    found[i][0] = int(place[at[0]])
                    taken[at[0]] = True
                    taken[at[0] + 1 :] = False
                found[i][1] += int(taken.sum())
                found[i][2] += float(delta[taken].sum())
                found[i][3] += float(gain[taken].sum())
                used[i] = float(upto[-1]) if len(upto) else used[i]
        columns = list(zip(*found, strict=True))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(state), pa.int32()), pa.array([b for b, _, _ in state], pa.int32()),
             *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["part", "b", "event", "selected", "tokens", "ndcg"],
        )

    return apply


def greedy_under_budgets(df: DataFrame, targets: list[float], lambda_cost: float = fv.LAMBDA_COST) -> list[dict]:
    """Reports of the greedy selection for each mean-token target.

    Free items first, then by gain per token, skipping items that do not fit; the result equals the item-by-item scan. First
    every budget takes the whole prefix that fits. From then on a round halves the room of every budget: items of at most
    half the room always fit until half of it is used, so prefix sums over these find the first item that uses it up, or
    the first larger item that fits; everything small before it is taken, and so is the item. The number of rounds is
    logarithmic in the ratio of the largest to the smallest item, and all budgets share them. Items are laid out once in
    their order; a round scans them twice. The driver holds one row per budget and range of items.
    """
    ship_package(df.sparkSession)
    delta = F.col("tok_c") - F.col("tok_d")
    rows = df.select(
        "request_id", "score", "mu_d", "tok_d", delta.alias("delta"), (F.col("mu_c") - F.col("mu_d")).alias("d_ndcg")
    )
    gains = F.col("score") > 0
    free = (F.col("delta") <= 0) & gains
    base = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("mu_d"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.sum("tok_d"), F.lit(0.0)).alias("tokens"),
        F.count_if(free).alias("selected"),
        F.coalesce(F.sum(F.when(free, F.col("delta"))), F.lit(0.0)).alias("free_tokens"),
        F.coalesce(F.sum(F.when(free, F.col("d_ndcg"))), F.lit(0.0)).alias("free_ndcg"),
        F.coalesce(F.min(F.when((F.col("delta") > 0) & gains, F.col("delta"))), F.lit(0.0)).alias("least"),
    ).first()
    n = base["n"]
    state = [
        {
            "budget": float(t), "after": 0, "ndcg": base["ndcg"] + base["free_ndcg"], "selected": base["selected"],
            "tokens": base["tokens"] + base["free_tokens"],
            "residual": float(t) * n + SLACK - base["tokens"] - base["free_tokens"],
        }
        for t in targets
    ]
    paid = rows.filter((F.col("delta") > 0) & gains).withColumn("density", F.col("score") / F.col("delta"))
    ordered = with_rank(
        paid.select("request_id", "density", "delta", "d_ndcg"),
        [F.desc("density"), F.asc("request_id")], sums={"used": "delta"}, rank="place", size="_n",
    ).select("place", "delta", "d_ndcg", "used")
    laid_out = cut_lineage(ordered.repartitionByRange("place").sortWithinPartitions("place"))

    def take(i: int, r: dict, after: int | None) -> None:
        s = state[i]
        for c in ("selected", "tokens", "ndcg"):
            s[c] += r[c]
        s["residual"] -= r["tokens"]
        s["after"] = after

    active = [i for i, s in enumerate(state) if s["residual"] > 0]
    if active:
        limits = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.lit(state[i]["residual"]).alias("residual")) for i in active]))
        fits = F.col("used") <= F.col("l.residual")
        first = laid_out.withColumn("l", limits).groupBy("l.b").agg(
            F.count_if(fits).alias("selected"),
            F.coalesce(F.sum(F.when(fits, F.col("delta"))), F.lit(0.0)).alias("tokens"),
            F.coalesce(F.sum(F.when(fits, F.col("d_ndcg"))), F.lit(0.0)).alias("ndcg"),
            F.min(F.when(~fits, F.col("place"))).alias("misfit"),
        ).collect()  # one row per budget
        for r in first:
            take(r["b"], r, r["misfit"])
    items = laid_out.select("place", "delta", "d_ndcg")
    while active := [i for i, s in enumerate(state) if s["after"] and s["residual"] >= base["least"]]:
        asked = [(i, state[i]["after"], state[i]["residual"]) for i in active]
        sums = items.mapInArrow(_part_sums(asked), "part int, b int, small double").toPandas().sort_values(["b", "part"])
        sums["before"] = sums.groupby("b")["small"].cumsum() - sums["small"]
        before = {(int(p), int(b)): float(x) for p, b, x in sums[["part", "b", "before"]].itertuples(index=False)}
        schema = "part int, b int, event bigint, selected bigint, tokens double, ndcg double"
        found = items.mapInArrow(_part_events(asked, before), schema).collect()
        for i in active:
            mine = sorted((r for r in found if r["b"] == i), key=lambda r: r["part"])
            stop = next((k for k, r in enumerate(mine) if r["event"] is not None), None)
            upto = mine if stop is None else mine[: stop + 1]
            total = {c: sum(r[c] for r in upto) for c in ("selected", "tokens", "ndcg")}
            take(i, total, None if stop is None else mine[stop]["event"])
    return [
        {
            "budget_mean_tokens": s["budget"], "selected": s["selected"], "mean_ndcg": s["ndcg"] / n,
            "mean_tokens": s["tokens"] / n, "total_tokens": s["tokens"],
            "utility": s["ndcg"] / n - lambda_cost * (s["tokens"] / n / 1000.0), "cot_rate": s["selected"] / n,
            "feasible": s["tokens"] / n <= s["budget"] + SLACK,
        }
        for s in state
    ]


BUDGET_SCHEMA = (
    "budget_mean_tokens double, selected bigint, mean_ndcg double, mean_tokens double, total_tokens double, "
    "utility double, cot_rate double, feasible boolean"
)


def budget_curve(df: DataFrame, targets: list[float], lambda_cost: float = fv.LAMBDA_COST) -> DataFrame:
    reports = greedy_under_budgets(df, targets, lambda_cost)
    columns = [c.split()[0] for c in BUDGET_SCHEMA.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in reports], BUDGET_SCHEMA)


def eta_for_budgets(df: DataFrame, targets: list[float]) -> DataFrame:
    """One row (target, eta) per target: density of the last item before the first one that does not fit; +inf if none fits.

    Unlike the greedy selection, items with a saving are not credited and the scan stops at a misfit. One scan in order of
    density answers all targets.
    """
    delta = F.col("tok_c") - F.col("tok_d")
    infinite = F.lit(float("inf"))
    rows = df.select(
        "request_id", "tok_d",
        F.when(delta > 0, F.col("score") / delta).otherwise(infinite).alias("density"),
        F.greatest(delta, F.lit(0.0)).alias("need"),
    )
    scanned = with_rank(rows, [F.desc("density"), F.asc("request_id")], sums={"used": "need", "spent": "tok_d"})
    base = F.max(F.when(F.col("rn") == F.col("n"), F.col("spent")))
    size = scanned.agg(F.struct(F.max("n").alias("n"), base.alias("base")).alias("size")).scalar()

    def last_fit(target: float) -> Column:
        room = F.lit(float(target)) * F.col("_size.n") + SLACK - F.col("_size.base")
        eta = F.min(F.when(F.col("used") <= room, F.col("density")))
        return F.struct(F.lit(float(target)).alias("target"), F.coalesce(eta, infinite).alias("eta"))

    found = scanned.withColumn("_size", size).agg(F.array(*[last_fit(t) for t in targets]).alias("x"))
    return found.select(F.explode("x").alias("x")).select("x.*")


def eta_for_budget(df: DataFrame, target: float) -> DataFrame:
    """One row ``eta`` for one target."""
    return eta_for_budgets(df, [target]).select("eta")


def rebuild_budget_policy(policy: dict | None, test: DataFrame) -> dict | None:
    """The dev target with a threshold recomputed on the test scores."""
    if policy is None:
        return None
    target = float(policy["target_mean_tokens"])
    eta = eta_for_budget(test, target).first()["eta"]
    return {"name": "budget_density", "target_mean_tokens": target, "eta": eta}


# --- policies that follow the better mode -----------------------------------------------------------


def apply_symmetric(policy: dict, signed: str = "signed") -> Column:
    """Assignment from the signed score (negated when direct is the better mode), rank rn and size n."""
    if policy["name"] == "top_r_tau":
        chosen = threshold_policy(F.col(signed), policy["tau"])
    elif policy["name"] in ("budget_topr_point", "utility_max_point"):
        chosen = top_rate_policy(policy["rate"])
    else:
        return F.lit(0)
    return chosen if policy.get("positive_mode", "cot") == "cot" else 1 - chosen


def policy_metrics(predictions: DataFrame, paired: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric per policy column (pred*), taken from the mode the policy chose."""
    names = [c for c in predictions.columns if c.startswith("pred")]
    long = predictions.unpivot("request_id", names, "policy", "pred").join(paired, "request_id")
    chosen = [
        F.avg(F.when(F.col("pred") == 1, F.col(f"`cot_{m}`")).otherwise(F.col(f"`direct_{m}`"))).alias(m) for m in metrics
    ]
    return long.groupBy("policy").agg(*chosen)
