"""Direct answers against step-by-step answers of the same requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegauge import fixed_values as fv


def find_run_columns(columns: list[str], base: str, k: int) -> list[str]:
    """The k run columns of a metric; case, blanks, '_' and '-' in their names do not matter, and exact names go first."""

    def plain(name: str) -> str:
        return re.sub(r"[\s_-]", "", name).lower()

    lookup: dict[str, str] = {}
    for name in sorted(columns, key=lambda c: not c.startswith(f"{base}_")):
        lookup.setdefault(plain(name), name)
    keys = [plain(f"{base}{i}") for i in range(1, k + 1)]
    lost = [i for i, key in enumerate(keys, 1) if key not in lookup]
    if lost:
        raise ValueError(f"metric {base} has no column for the runs {lost}")
    return [lookup[key] for key in keys]


def _zero_if_failed(col: str) -> Column:
    value = F.col(f"`{col}`").cast("double")
    return F.when(value == fv.NONE_VALUE, F.lit(0.0)).otherwise(value)


def load_metrics(
    wide: DataFrame, k: int = fv.K_RUNS, ndcg_base: str = "ndcg10", recall_base: str = "recall10",
    load_recall: bool = False, keys=("request_id",),
) -> DataFrame:
    """Metrics as training sees them: -1 counts as 0, and a NaN average falls back to the run mean."""
    out = list(keys)
    for base, label, wanted in ((ndcg_base, "ndcg", True), (recall_base, "recall", load_recall)):
        if not wanted:
            continue
        runs = F.array(*[_zero_if_failed(c) for c in find_run_columns(wide.columns, base, k)])
        mean = F.aggregate(runs, F.lit(0.0), lambda s, x: s + x) / k
        average = f"avg_{label}@10"
        stored = F.nanvl(_zero_if_failed(average), F.lit(None).cast("double")) if average in wide.columns else None
        out += [
            runs.alias(f"{label}_runs"),
            mean.alias(f"mean_{label}"),
            (mean if stored is None else F.coalesce(stored, mean)).alias(f"avg_{label}_at_10"),
        ]
    return wide.select(*out)


def pair_modes(direct: DataFrame, cot: DataFrame, columns: list[str]) -> DataFrame:
    """One row per request with direct_* and cot_* columns; a request present on one side only is an error."""
    d = direct.select(F.col("request_id").alias("d_id"), *[F.col(f"`{c}`").alias(f"direct_{c}") for c in columns])
    c = cot.select(F.col("request_id").alias("c_id"), *[F.col(f"`{x}`").alias(f"cot_{x}") for x in columns])
    joined = d.join(c, F.col("d_id") == F.col("c_id"), "full")
    same = F.col("d_id").isNotNull() & F.col("c_id").isNotNull()
    checked = F.when(same, F.col("d_id")).otherwise(
        F.raise_error(F.lit("a request was answered in one mode only")).cast("bigint")
    )
    return joined.select(checked.alias("request_id"), *[f"direct_{x}" for x in columns], *[f"cot_{x}" for x in columns])


def pair_long(long: DataFrame, columns: list[str]) -> DataFrame:
    """The same pairing from one long table with the column ``mode``, in a single aggregate."""

    def of(mode: str, column: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(f"`{column}`"))).alias(f"{mode}_{column}")

    paired = long.groupBy("request_id").agg(
        F.count_if(F.col("mode") == "direct").alias("_d"), F.count_if(F.col("mode") == "cot").alias("_c"),
        *[of(mode, c) for mode in ("direct", "cot") for c in columns],
    )
    one_each = (F.col("_d") == 1) & (F.col("_c") == 1)
    checked = F.when(one_each, F.col("request_id")).otherwise(
        F.raise_error(F.lit("a request was answered in one mode only")).cast("bigint")
    )
    return paired.select(checked.alias("request_id"), *[f"`{m}_{c}`" for m in ("direct", "cot") for c in columns])


def mode_label(paired: DataFrame, metric: str = "avg_ndcg@10") -> DataFrame:
    """1 when step-by-step is better, 0 when direct is, 2 for a tie; falls back to plain avg_ndcg."""
    if f"cot_{metric}" not in paired.columns:
        metric = "avg_ndcg"
    c, d = F.col(f"`cot_{metric}`"), F.col(f"`direct_{metric}`")
    return paired.select("request_id", F.when(c > d, 1).when(c < d, 0).otherwise(2).alias("label"))


def oracle_mix(paired: DataFrame, metric: str = "avg_ndcg@10") -> DataFrame:
    """Per request the better mode, direct on ties."""
    use = F.col(f"`cot_{metric}`") > F.col(f"`direct_{metric}`")
    return paired.select(
        "request_id",
        F.when(use, F.col(f"`cot_{metric}`")).otherwise(F.col(f"`direct_{metric}`")).alias("mixed_ndcg"),
        F.when(use, F.col("cot_avg_tokens")).otherwise(F.col("direct_avg_tokens")).alias("mixed_tokens"),
        use.cast("int").alias("chosen"),
    )


def win_rates(paired: DataFrame, metric: str = "avg_ndcg@10") -> DataFrame:
    c, d = F.col(f"`cot_{metric}`"), F.col(f"`direct_{metric}`")
    return paired.agg(
        F.avg((c > d).cast("double")).alias("cot_rate"), F.avg((c < d).cast("double")).alias("direct_rate")
    )
