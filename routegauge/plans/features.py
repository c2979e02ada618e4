"""Vector features of recommendation and retrieval requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.operators import vector_features as E
from routegauge.operators import whole_requests as W
from routegauge.plans.registry import plan, rounded
from routegauge.session import materialise, scratch_path
from routegauge.sources import derived as D
from routegauge.sources import readers, sinks


def _rec(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """The named features of every request. The requests are stored once, as lists of ids."""
    req = materialise(D.requests(spark, sf_dir).select("request_id", "history", "candidates"), "requests")
    found = W.features(D.rec_vector_lists(spark, sf_dir, req), D.embeddings(spark, sf_dir), names)
    return E.fill_zero(req, found, names)


def _ir(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # the blocks are written once because profile, joins and matrix products all read them
    table = materialise(E.blocks(E.usable(D.ir_vectors(spark, sf_dir))), "vector-blocks", "section")
    req = D.embeddings(spark, sf_dir).select(F.col("vec_id").alias("request_id"))
    return req, table, E.profile(table)


def _filled(req: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    return rounded(E.fill_zero(req, features, names))


def _named(part: str) -> list[str]:
    return [c for c in E.REC_FEATURES if part in c]


@plan
def vec_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["hist_len", "hist_embedding_variance", "cand_embedding_dispersion", "hist_cov_trace", "cand_cov_trace"]
    return rounded(_rec(spark, sf_dir, names))


@plan
def vec_svd3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, _named("singular")))


@plan
def hist_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, _named("hist_adj")))


@plan
def hist_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, ["hist_drift_cos"]))


@plan
def cand_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, _named("cand_pairwise")))


@plan
def hist_cand_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, [c for c in _named("history_candidate_sim") if "gap" not in c]))


@plan
def sim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["top1_sim", "top10_sim", "top_k_sim_gap", "history_candidate_sim_top1_top2_gap"] + _named("cand_sim_>")
    return rounded(_rec(spark, sf_dir, names))


@plan
def recent_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, ["c2h_recentK_mean", "c2h_recentK_max"]))


@plan
def centroid_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["hist_cand_centroid_cos", "hist_cand_centroid_dist", "cand_centroid_norm", "cand_density_wrt_hist"]
    return rounded(_rec(spark, sf_dir, names))


@plan
def cand_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rec(spark, sf_dir, ["cand_cluster_size_entropy_k3", "ambiguous_cluster_score"]))


@plan
def query_cand_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    req, table, prof = _ir(spark, sf_dir)
    near = E.candidate_query(table, prof)
    sides = E.ir_sides(prof)
    names = [c for c in E.IR_FEATURES if c.startswith("query_candidate_sim")] + [
        "top1_sim", "top10_sim", "top_k_sim_gap", "query_norm", "cand_embedding_dispersion", "cand_cov_trace",
        "cand_centroid_norm", "qc_centroid_cos", "qc_centroid_dist", "cand_density_wrt_query",
    ]
    return _filled(req, near.join(sides, "request_id"), names)


def rec_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rec(spark, sf_dir, E.REC_FEATURES)


@plan
def rec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec_feature_table(spark, sf_dir))


@plan
def ir_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = D.embeddings(spark, sf_dir).select(F.col("vec_id").alias("request_id"))
    return rounded(E.ir_features(req, D.ir_vectors(spark, sf_dir)))


def _without_iterated(features: DataFrame) -> DataFrame:
    """All but the singular values and clusters, which plain SQL cannot state."""
    return features.drop(*[c for c in features.columns if "singular" in c or "cluster" in c])


@plan
def rec_features_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide recommendation table without its iterated columns, so that one statement checks the whole row."""
    return _without_iterated(rec_features(spark, sf_dir))


@plan
def ir_features_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide retrieval table without its iterated columns."""
    return _without_iterated(ir_features(spark, sf_dir))


def features_of_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One feature row per record of an entry file; any kind that is not a retrieval kind counts as recommendation."""
    entries = materialise(readers.read_entries(spark, path), "entries")  # ids given to records without one must stay
    vectors = readers.entry_vectors(entries)
    compute = E.ir_features if kind in fv.IR_KINDS else E.rec_features
    return compute(readers.entry_numbers(entries), vectors)


@plan
def entry_file_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval features by way of an entry file: ten candidates and a query a record."""
    vectors = D.ir_vectors(spark, sf_dir)
    listed = F.sort_array(F.collect_list(F.when(F.col("section") == "candidate", F.struct("pos", "item_id", "vec"))))
    asked = F.first(F.when(F.col("section") == "query", F.col("vec")), True)
    entries = D.embeddings(spark, sf_dir).select(F.col("vec_id").alias("request_id")).join(
        vectors.groupBy("request_id").agg(listed.alias("c"), asked.alias("q")), "request_id", "left"
    ).select(
        F.col("request_id").cast("string").alias("entry_id"),
        F.transform("c", lambda x: F.struct(x["item_id"].alias("item_id"), x["vec"].alias("embedding"))).alias("candidates"),
        F.struct(F.col("q").alias("embedding")).alias("query"),
    )
    path = scratch_path(spark, "entry-lines")
    sinks.write_entries(entries, path, shard_size=5000, fmt="json")
    return _without_iterated(rounded(features_of_entries(spark, path, "rank_ir")))


@plan
def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written as ``::`` lines and as CSV, and read back from both."""
    items = D.items(spark, sf_dir)
    dat, csv = scratch_path(spark, "catalogue-dat"), scratch_path(spark, "catalogue-csv")
    items.select(F.concat_ws("::", "item_id", "title", "genres")).write.option("encoding", "ISO-8859-1").text(dat)
    sinks.write_table(items.select("item_id", "title"), csv, "csv")
    lines = readers.read_items(spark, dat).withColumn("file", F.lit("lines"))
    table = readers.read_items_csv(spark, csv).withColumn("genres", F.lit(None).cast("string")).withColumn("file", F.lit("csv"))
    return lines.unionByName(table)
