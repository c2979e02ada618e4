"""Feature merging, train/dev split, advantage labels and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.functions.hashing import key
from routegauge.operators.ranking import quantiles


def merge_features(base: DataFrame, extra: DataFrame | None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Add the wanted columns that exist; no table or no such column leaves the base as it is."""
    if extra is None:
        return base.drop("entry_id")
    wanted = [c for c in (only or extra.columns) if c in extra.columns and c not in ("request_id", "entry_id")]
    if wanted:
        base = base.join(extra.select("request_id", *wanted), "request_id", "left")
    return base.drop("entry_id")


def select_features(df: DataFrame, wanted: list[str], all_columns: list[str], include_delta: bool = True) -> DataFrame:
    """Keep the listed features that exist, or all when none does; the token difference always stays."""
    kept = [c for c in wanted if c in all_columns] or list(all_columns)
    if include_delta and "delta_tokens_mean" not in kept:
        kept.append("delta_tokens_mean")
    return df.select("request_id", *kept)


def split_train_dev(bundle: DataFrame, dev_ratio: float = fv.DEV_RATIO, seed: int = fv.SPLIT_SEED) -> DataFrame:
    """Relabel part of the rows of split 'train' as 'dev'; other splits stay untouched.

    Rows are shuffled by a seeded hash; the first round(n * (1 - ratio)) of them stay in train. The border is selected,
    not sorted for: counts per hash prefix name the prefix it lies in, and only that prefix's rows, one in 65,536, are
    put in order. ``bundle`` is read three times and should be stored.
    """
    keyed = bundle.withColumn("_shuffle", F.md5(key("request_id", F.lit(seed))))
    train = keyed.filter(F.col("split") == "train").select("_shuffle", "request_id", F.substring("_shuffle", 1, 4).alias("prefix"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows
    counted = train.groupBy("prefix").agg(F.count(F.lit(1)).alias("c")).select(
        "prefix", "c", F.sum("c").over(upto).alias("end"),
        F.bround(F.sum("c").over(everything) * F.lit(1.0 - dev_ratio)).cast("bigint").alias("kept"),
    )
    at = counted.filter((F.col("end") >= F.col("kept")) & (F.col("end") - F.col("c") < F.col("kept"))).first()
    if at is None:  # no train rows, or none of them stays
        late = F.lit(True)
    else:
        place = F.row_number().over(Window.orderBy("_shuffle", "request_id"))
        inside = train.filter(F.col("prefix") == at["prefix"]).withColumn("place", place)
        last = inside.filter(F.col("place") == at["kept"] - at["end"] + at["c"]).first()
        border = F.struct(F.lit(last["_shuffle"]).alias("_shuffle"), F.lit(last["request_id"]).alias("request_id"))
        late = F.struct("_shuffle", "request_id") > border
    split = F.when((F.col("split") == "train") & late, F.lit("dev")).otherwise(F.col("split"))
    return keyed.withColumn("split", split).drop("_shuffle")


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def trimmed_mean(runs: Column, trim: float = fv.TRIM_RATIO) -> Column:
    """Mean without floor(trim * k) values at both ends."""
    cut = F.floor(F.lit(trim) * F.size(runs)).cast("int")
    kept = F.slice(F.array_sort(runs), cut + 1, F.greatest(F.size(runs) - 2 * cut, F.lit(0)))
    return F.when(F.size(kept) > 0, array_mean(kept)).otherwise(array_mean(runs))


def population_variance(runs: Column) -> Column:
    mean = array_mean(runs)
    return F.aggregate(runs, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(runs)


def utility(mu: Column, tokens: Column, lambda_cost: float) -> Column:
    return mu - F.lit(float(lambda_cost)) * (tokens / F.lit(1000.0))


def advantage(
    df: DataFrame, lambda_cost: float = fv.LAMBDA_COST, eps: float = fv.EPS_EQUAL, alpha: float = fv.ALPHA_VAR
) -> DataFrame:
    """Add advantage (small values pulled to 0) and weight from mu_d, mu_c, var_d, var_c, tok_d, tok_c."""
    gap = utility(F.col("mu_c"), F.col("tok_c"), lambda_cost) - utility(F.col("mu_d"), F.col("tok_d"), lambda_cost)
    return df.withColumns(
        {
            "advantage": F.when(F.abs(gap) < eps, F.lit(0.0)).otherwise(gap),
            "weight": F.exp(F.lit(-float(alpha)) * (F.col("var_d") + F.col("var_c"))),
        }
    )


def rank_thresholds(df: DataFrame, eps: float = fv.EPS_EQUAL, probs=fv.RANK_QUANTILES) -> DataFrame:
    """One row: sorted distinct thresholds of the positive advantages and the gain of each grade."""
    positive = df.filter(F.col("advantage") > eps)
    table = quantiles(positive, "advantage", "request_id", {f"q{i}": p for i, p in enumerate(probs)})
    # An aggregate without groups keeps one row even when nothing is positive.
    row = table.agg(F.max(F.when(F.col("n") >= fv.MIN_POSITIVES, F.array(*[f"q{i}" for i in range(len(probs))]))).alias("t"))
    cuts = F.array_sort(F.array_distinct(F.coalesce(F.col("t"), F.array().cast("array<double>"))))
    gains = F.concat(
        F.array(F.lit(0.0)),
        F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.pow(F.lit(2.0), i.cast("double"))),
    )
    return row.select(cuts.alias("thresholds"), gains.alias("gains"))


def rank_labels(df: DataFrame, thresholds: DataFrame, eps: float = fv.EPS_EQUAL) -> DataFrame:
    """Grade 0 up to eps, else 1 plus the number of thresholds exceeded."""
    cuts = thresholds.select("thresholds").scalar()
    above = F.size(F.filter(F.col("_cuts"), lambda t: F.col("advantage") > t))
    return df.withColumn("_cuts", cuts).withColumn(
        "grade", F.when(F.col("advantage") <= eps, 0).otherwise(1 + above)
    ).drop("_cuts")
