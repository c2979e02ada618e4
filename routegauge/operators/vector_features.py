"""Features of a request's vectors.

Input is the long entry table (request_id, section, pos, item_id, vec) with sections history, candidate
and query. Statistics are partial aggregates per request. All-pairs work runs on blocks of at most
``BLOCK`` vectors, so a request of any size spreads over tasks; a usual request is a single block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.functions import matrices as M
from routegauge.functions import vectors as V
from routegauge.session import cut_lineage, materialise

CHUNK = 4096  # rows of one request that one window task orders
BLOCK = 256  # vectors of one request that one matrix product holds
BUCKETS = 4096  # value buckets per unit of similarity
PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def usable(entries: DataFrame) -> DataFrame:
    """Rows with a vector v, their place dpos among the usable rows of the section, and its size n.

    Places are counted per chunk of the original positions and shifted by the chunks before.
    """
    rows = entries.filter(F.col("vec").isNotNull()).select(
        "request_id", "section", "pos", F.floor(F.col("pos") / CHUNK).alias("chunk"), F.col("vec").alias("v")
    )
    keys = ["request_id", "section", "chunk"]
    section = Window.partitionBy("request_id", "section")
    before = section.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("len")).select(
        *keys, F.coalesce(F.sum("len").over(before), F.lit(0)).alias("skip"), F.sum("len").over(section).alias("n")
    )
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    joined = placed.join(sizes, keys)
    return joined.withColumn("dpos", F.col("skip") + F.col("at") - 1).drop("skip", "at", "chunk")


def blocks(rows: DataFrame) -> DataFrame:
    """request_id, section, block, blocks (how many the section has), n, m: at most BLOCK vectors in order."""
    return rows.groupBy("request_id", "section", F.floor(F.col("dpos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"),
        F.max(F.ceil(F.col("n") / BLOCK)).alias("blocks"),
        F.transform(F.sort_array(F.collect_list(F.struct("dpos", "v"))), lambda s: s["v"]).alias("m"),
    )


def profile(table: DataFrame) -> DataFrame:
    """One row per request with sizes, sums and centroids of hist, early, late, recent, cand and query.

    Each block contributes partial sums; only requests of several blocks need them added up.
    """
    names = ("hist", "early", "late", "recent", "cand", "query")
    partial = table.select(
        "request_id", "blocks", F.explode(M.block_parts("m", "section", F.col("block") * BLOCK, "n")).alias("p")
    ).select("request_id", "blocks", "p.*")
    single = partial.filter(F.col("blocks") == 1).drop("blocks")
    added = partial.filter(F.col("blocks") > 1).groupBy("request_id", "part").agg(
        *[F.sum(c).alias(c) for c in ("n", "squares", "cells")], *[V.sum_vector(F.col(c)).alias(c) for c in ("vsum", "usum")]
    )

    def mean(c: str) -> Column:
        return F.transform(F.col(c), lambda x: x / F.col("n"))

    means = single.unionByName(added).select(
        "request_id", "part", "n", "squares", "cells", mean("vsum").alias("centroid"), mean("usum").alias("unit_mean")
    )
    return means.groupBy("request_id").agg(*[
        F.first(F.when(F.col("part") == p, F.struct("n", "squares", "cells", "centroid", "unit_mean")), True).alias(p)
        for p in names
    ])


def _variance(part: str) -> Column:
    """Population variance of all matrix cells."""
    cells = F.col(f"{part}.n") * F.size(f"{part}.centroid")
    mean = F.col(f"{part}.cells") / cells
    return F.coalesce(F.greatest(F.col(f"{part}.squares") / cells - mean * mean, F.lit(0.0)), F.lit(0.0))


def _scatter(part: str) -> Column:
    """Trace of the sample covariance."""
    n = F.col(f"{part}.n")
    spread = F.col(f"{part}.squares") - n * V.norm2(F.col(f"{part}.centroid"))
    return F.greatest(spread, F.lit(0.0)) / F.greatest(n - 1, F.lit(1))


def both_sides() -> Column:
    return F.col("hist").isNotNull() & F.col("cand").isNotNull()


def _cosine(a: Column, b: Column) -> Column:
    return V.dot(V.unit_vector(a), V.unit_vector(b))


def spread_columns() -> dict[str, Column]:
    """Variances always; covariance traces only when both sides have vectors."""
    return {
        "hist_len": F.coalesce(F.col("hist.n"), F.lit(0)).cast("double"),
        "hist_embedding_variance": _variance("hist"),
        "cand_embedding_dispersion": _variance("cand"),
        "hist_cov_trace": F.when(both_sides(), _scatter("hist")),
        "cand_cov_trace": F.when(both_sides(), _scatter("cand")),
    }


def drift_columns() -> dict[str, Column]:
    return {"hist_drift_cos": _cosine(F.col("early.centroid"), F.col("late.centroid"))}


def centroid_columns() -> dict[str, Column]:
    h, c = F.col("hist.centroid"), F.col("cand.centroid")
    return {
        "hist_cand_centroid_cos": _cosine(h, c),
        "hist_cand_centroid_dist": V.distance(c, h),
        "cand_centroid_norm": V.norm(c),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def spread(prof: DataFrame) -> DataFrame:
    return prof.select("request_id", *_named(spread_columns()))


def drift(prof: DataFrame) -> DataFrame:
    return prof.filter(both_sides()).select("request_id", *_named(drift_columns()))


def centroids(prof: DataFrame) -> DataFrame:
    return prof.filter(both_sides()).select("request_id", *_named(centroid_columns()))


def adjacent(table: DataFrame) -> DataFrame:
    """Mean and population deviation of the cosine between neighbours of the history."""
    history = table.filter(F.col("section") == "history")
    inside = history.select("request_id", F.explode(M.neighbour_cosines("m")).alias("s"))
    many = history.filter(F.col("blocks") > 1)
    heads = many.filter(F.col("block") > 0).select("request_id", "block", F.get("m", F.lit(0)).alias("head"))
    tails = many.select("request_id", (F.col("block") + 1).alias("block"), F.element_at("m", -1).alias("tail"))
    across = heads.join(tails, ["request_id", "block"]).select("request_id", M.cosine("tail", "head").alias("s"))
    return inside.unionByName(across).groupBy("request_id").agg(
        F.avg("s").alias("hist_adj_cos_mean"), F.stddev_pop("s").alias("hist_adj_cos_std")
    )


# --- similarity of candidates to history or query ---------------------------------------------------


def picks(n: Column) -> dict[str, Column]:
    """0-based ascending places of the wanted order statistics among n values."""
    out = {"top1": n - 1, "top2": F.greatest(n - 2, F.lit(0)), "top10": F.greatest(n - 10, F.lit(0))}
    for name, p in PROBS.items():
        low = F.floor((n - 1) * F.lit(p))
        out[f"{name}_lo"] = low
        out[f"{name}_hi"] = F.least(low + 1, n - 1)
    return out


def _order_statistics(rows: DataFrame) -> DataFrame:
    """Order statistics without listing a group: counts per value, ordered within narrow value buckets."""
    values = rows.groupBy("request_id", "n", "sim").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("b", F.floor(F.col("sim") * BUCKETS))
    before = Window.partitionBy("request_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = values.groupBy("request_id", "b").agg(F.sum("c").alias("len")).select(
        "request_id", "b", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("skip")
    )
    upto = Window.partitionBy("request_id", "b").orderBy("sim").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("upto", F.sum("c").over(upto)).join(buckets, ["request_id", "b"])
    end = F.col("skip") + F.col("upto")
    hit = {k: (end - F.col("c") <= i) & (i < end) for k, i in picks(F.col("n")).items()}
    return placed.groupBy("request_id").agg(*[F.max(F.when(h, F.col("sim"))).alias(k) for k, h in hit.items()])


def _lerp(row: str, name: str) -> Column:
    lo, hi = F.col(f"{row}{name}_lo"), F.col(f"{row}{name}_hi")
    at = (F.col("n") - 1) * F.lit(PROBS[name])
    return lo + (hi - lo) * (at - F.floor(at))


def similarity_statistics(sims: DataFrame, prefix: str, extra: list[Column] = ()) -> DataFrame:
    """Statistics of the column ``sim`` per request; ``n`` is the number of rows of the request."""
    sims = materialise(sims, "similarities")  # read by the aggregate and by the order statistics
    stats = sims.groupBy("request_id").agg(
        F.max("n").alias("n"),
        F.max("sim").alias(f"{prefix}_sim_max"),
        F.avg("sim").alias(f"{prefix}_sim_mean"),
        F.min("sim").alias(f"{prefix}_sim_min"),
        F.var_pop("sim").alias(f"{prefix}_sim_var"),
        *[F.avg((F.col("sim") > t).cast("double")).alias(f"cand_sim_>{t}_ratio") for t in (0.3, 0.5, 0.7)],
        *extra,
    )
    picked = stats.join(_order_statistics(sims.select("request_id", "n", "sim")), "request_id")
    return from_places(picked, [c for c in stats.columns if c != "n"], prefix)


def from_places(picked: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """The columns kept, with quantiles and leading values from the order statistics beside them."""
    return picked.select(
        *[F.col(f"`{c}`") for c in keep],
        *[_lerp("", p).alias(f"{prefix}_sim_{p}") for p in PROBS],
        F.col("top1").alias("top1_sim"),
        F.col("top10").alias("top10_sim"),
        (F.col("top1") - F.col("top10")).alias("top_k_sim_gap"),
        F.when(F.col("n") >= 2, F.col("top1") - F.col("top2")).alias(f"{prefix}_sim_top1_top2_gap"),
    )


def candidate_history(table: DataFrame, prof: DataFrame) -> DataFrame:
    """Every statistic of candidates against history.

    The mean cosine to all history vectors is one dot product with the mean of their unit vectors.
    """
    sides = prof.filter(both_sides()).select(
        "request_id", F.col("hist.unit_mean").alias("hu"), F.col("recent.unit_mean").alias("ru"),
        F.col("hist.centroid").alias("hc"),
    )
    cands = table.filter(F.col("section") == "candidate").select("request_id", "n", "m").join(sides, "request_id")
    sims = cands.select("request_id", "n", F.explode(M.near_history("m", "hu", "ru", "hc")).alias("s"))
    return similarity_statistics(sims.select("request_id", "n", "s.*"), "history_candidate", [
        F.avg("recent").alias("c2h_recentK_mean"), F.max("recent").alias("c2h_recentK_max"),
        F.avg("dist").alias("cand_density_wrt_hist"),
    ])


def candidate_query(table: DataFrame, prof: DataFrame) -> DataFrame:
    q = prof.filter(F.col("query").isNotNull() & F.col("cand").isNotNull()).select(
        "request_id", F.col("query.centroid").alias("q"), F.col("query.unit_mean").alias("qu")
    )
    cands = table.filter(F.col("section") == "candidate").select("request_id", "n", "m").join(q, "request_id")
    sims = cands.select("request_id", "n", F.explode(M.near_history("m", "qu", "qu", "q")).alias("s"))
    return similarity_statistics(
        sims.select("request_id", "n", "s.*"), "query_candidate", [F.avg("dist").alias("cand_density_wrt_query")]
    )


# --- all-pairs work on blocks -----------------------------------------------------------------------


def block_pairs(table: DataFrame, *columns: str) -> DataFrame:
    """Every unordered pair of blocks of a request, with the columns of both sides as l_* and r_*.

    A block is sent to each partner under the partner's key, so the pairs of one request spread over tasks.
    """
    alone = F.col("blocks") == 1
    single = table.filter(alone).select(
        "request_id", *[F.col(c).alias(f"l_{c}") for c in columns], *[F.col(c).alias(f"r_{c}") for c in columns],
        F.lit(True).alias("same"),
    )
    many = table.filter(~alone)
    sent = many.select(
        "request_id", F.col("block").alias("from_block"),
        F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"),
        *[F.col(c).alias(f"l_{c}") for c in columns],
    )
    partner = many.select("request_id", "block", *[F.col(c).alias(f"r_{c}") for c in columns])
    paired = sent.join(partner, ["request_id", "block"]).withColumn("same", F.col("from_block") == F.col("block"))
    return single.unionByName(paired.drop("from_block", "block"))


def _least_cosines(many: DataFrame, anchors: DataFrame) -> DataFrame:
    """(request_id, low): the least cosine over all pairs of rows, for requests of several blocks.

    Two rows are no farther apart than their angles to an anchor together. The row at the widest angle is compared with all
    others; only rows wide enough to come farther apart than the farthest pair so found are compared with one another.
    """
    at = many.join(anchors, "request_id")
    wide = at.select("request_id", "block", M.widest_row("m", "anchor").alias("f")).groupBy("request_id").agg(
        F.max("f.gap").alias("widest"), F.max_by("f.v", F.struct(F.col("f.gap"), -F.col("block"))).alias("v")
    )
    bound = many.join(wide, "request_id").select("request_id", M.least_cosine("m", "v").alias("low")).groupBy("request_id").agg(F.min("low").alias("low"))
    needed = bound.join(wide, "request_id").select("request_id", "low", (F.acos(F.greatest("low", F.lit(-1.0))) - F.col("widest") - 1e-9).alias("needed"))
    needed = materialise(needed, "pair-bounds")
    left = at.join(needed, "request_id").select("request_id", "block", "blocks", M.rows_beyond("m", "anchor", "needed").alias("m"))
    left = materialise(left.filter(F.size("m") > 0), "wide-rows")
    found = block_pairs(left, "m").select("request_id", M.pair_products("l_m", "r_m", "same").alias("p")).select("request_id", "p.low")
    return found.unionByName(needed.select("request_id", "low")).groupBy("request_id").agg(F.min("low").alias("low"))


def pairwise(table: DataFrame) -> DataFrame:
    """Mean, population deviation and minimum of the cosine over all candidate pairs.

    A request of one block has its products taken in one piece. For larger ones the mean follows from the sum of the unit
    vectors and the deviation from their Gram matrix, both linear in the vectors; only the minimum needs pairs.
    """
    own = table.filter(F.col("section") == "candidate")
    small = own.filter(F.col("blocks") == 1).select("request_id", M.pair_products("m", "m", F.lit(True)).alias("p"))
    merged = small.select("request_id", "p.cnt", "p.total", "p.squares", "p.low")
    many = own.filter(F.col("blocks") > 1).select("request_id", "block", "blocks", "m")
    if not many.isEmpty():
        sums = many.select("request_id", M.unit_sums("m").alias("u")).groupBy("request_id").agg(
            *[F.sum(f"u.{c}").alias(c) for c in ("n", "ones", "fourths")],
            V.sum_vector(F.col("u.total")).alias("anchor"), V.sum_vector(F.col("u.gram")).alias("gram"),
        )
        sums = materialise(sums, "unit-sums")
        linear = sums.select(
            "request_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("cnt"),
            ((V.norm2(F.col("anchor")) - F.col("ones")) / 2).alias("total"), ((V.norm2(F.col("gram")) - F.col("fourths")) / 2).alias("squares"),
        )
        merged = merged.unionByName(linear.join(_least_cosines(many, sums.select("request_id", "anchor")), "request_id"))
    return _pair_statistics(merged)


def _pair_statistics(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("cnt") > 0).select("request_id", *_named(pair_columns()))


def pair_columns() -> dict[str, Column]:
    """From the number of pairs, the sum and the squares of their cosines, and the least one."""
    mean = F.col("total") / F.col("cnt")
    return {
        "cand_pairwise_cos_mean": mean,
        "cand_pairwise_cos_std": F.sqrt(F.greatest(F.col("squares") / F.col("cnt") - mean * mean, F.lit(0.0))),
        "cand_pairwise_cos_min": F.col("low"),
    }


def singular_sum(table: DataFrame, prof: DataFrame, section: str, part: str, name: str) -> DataFrame:
    """Sum of the top three singular values of the centred matrix of a section.

    They are the roots of the eigenvalues of the Gram matrix of the centred rows; Grams of several blocks add up.
    """
    centre = prof.select("request_id", F.col(f"{part}.centroid").alias("mean"))
    own = table.filter(F.col("section") == section).select("request_id", "blocks", "m").join(centre, "request_id")
    small = own.filter(F.col("blocks") == 1).select("request_id", M.top3_singular("m", "mean").alias(name))
    merged = own.filter(F.col("blocks") > 1).select("request_id", M.centred_gram("m", "mean").alias("g")).groupBy(
        "request_id"
    ).agg(V.sum_vector(F.col("g")).alias("g"))
    return small.unionByName(merged.select("request_id", M.top3_from_gram("g").alias(name)))


def _at_blocks(many: DataFrame, centres: DataFrame) -> DataFrame:
    """Blocks with their request's centres, joined per block so that a large request stays on many tasks."""
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    return many.join(centres.select("request_id", "centres", each), ["request_id", "block"])


def _farthest(many: DataFrame, centres: DataFrame) -> DataFrame:
    """One more centre per request: the row farthest from its nearest centre, the first one on ties."""
    found = _at_blocks(many, centres).select("request_id", "block", M.farthest_row("m", "centres").alias("f"))
    best = found.groupBy("request_id").agg(F.max_by("f.v", F.struct(F.col("f.gap"), -F.col("block"))).alias("v"))
    return centres.join(best, "request_id").select("request_id", "blocks", F.concat("centres", F.array("v")).alias("centres"))


def _means(many: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """The centres moved to the means of their rows: sums per block, then per request; an empty cluster stays."""
    sums = many.join(labels, ["request_id", "block"]).select("request_id", F.explode(M.label_sums("m", "labels")).alias("s"))
    added = sums.groupBy("request_id", "s.label").agg(F.sum("s.n").alias("n"), V.sum_vector(F.col("s.total")).alias("total"))
    mean = added.select("request_id", "label", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    wide = mean.groupBy("request_id").agg(
        *[F.first(F.when(F.col("label") == j, F.col("mean")), True).alias(f"m{j}") for j in range(M.CLUSTERS)]
    )
    moved = F.array(*[F.coalesce(f"m{j}", F.get("centres", F.lit(j))) for j in range(M.CLUSTERS)])
    return centres.join(wide, "request_id").select("request_id", "blocks", moved.alias("centres"))


def _labels_of_many(many: DataFrame) -> DataFrame:
    """Lloyd's steps of ``matrices.lloyd`` for requests of several blocks: request_id, block, labels.

    A request is done when none of its labels moves; only the others go on. Every step reads blocks and writes labels
    and three centres a request.
    """
    def labelled(blocks_left: DataFrame, centres: DataFrame) -> DataFrame:
        at = _at_blocks(blocks_left, centres)
        return at.select("request_id", "block", M.nearest_labels("m", "centres").alias("labels"))

    centres = many.filter(F.col("block") == 0).select("request_id", "blocks", F.slice("m", 1, 1).alias("centres"))
    for _ in range(1, M.CLUSTERS):
        centres = _farthest(many, centres)
    centres = cut_lineage(centres)
    many = many.drop("blocks")
    labels = materialise(labelled(many, centres), "labels")
    left, done = many, []
    while True:
        centres = cut_lineage(_means(left, labels, centres))
        after = materialise(labelled(left, centres), "labels")
        changed = after.join(labels.withColumnRenamed("labels", "old"), ["request_id", "block"])
        moving = cut_lineage(changed.filter(F.col("labels") != F.col("old")).select("request_id").distinct())
        done.append(after.join(moving, "request_id", "left_anti"))
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = many.join(moving, "request_id", "left_semi")
        labels = after.join(moving, "request_id", "left_semi")
        centres = centres.join(moving, "request_id", "left_semi")


def clusters(table: DataFrame) -> DataFrame:
    """Entropy of the sizes of three clusters, and the deviation between clusters of their mean distance."""
    table = table.filter(F.col("section") == "candidate").drop("section", "n")
    small = table.filter(F.col("blocks") == 1).withColumn("labels", M.cluster_labels("m")).filter(F.size("labels") > 0)
    many = table.filter(F.col("blocks") > 1)
    labelled = small
    if not many.isEmpty():  # nothing to iterate otherwise
        doubles = F.transform("m", lambda v: v.cast("array<double>"))
        labels = _labels_of_many(many.select("request_id", "block", "blocks", doubles.alias("m")))
        labelled = small.unionByName(many.join(labels, ["request_id", "block"]))

    def holds(j: int) -> Column:
        return F.size(F.filter("labels", lambda label: label == j))

    sizes = labelled.groupBy("request_id").agg(*[F.sum(holds(j)).alias(f"n{j}") for j in range(M.CLUSTERS)])
    pairs = block_pairs(labelled, "m", "labels")
    sums = pairs.select(
        "request_id", M.label_distances("l_m", "l_labels", "r_m", "r_labels", "same").alias("d")
    ).groupBy("request_id").agg(*[F.sum(F.get("d", F.lit(j))).alias(f"d{j}") for j in range(M.CLUSTERS)])
    return cluster_statistics(sizes.join(sums, "request_id"))


def cluster_statistics(joined: DataFrame, keep: list[str] = ("request_id",)) -> DataFrame:
    """From rows n0.. and sums of distances d0.. of the clusters of a request, beside the columns kept."""
    count = reduce(Column.__add__, [F.col(f"n{j}") for j in range(M.CLUSTERS)])
    shares = [F.try_divide(f"n{j}", count) for j in range(M.CLUSTERS)]
    entropy = reduce(Column.__add__, [F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)) for p in shares])
    means = F.array_compact(F.array(*[
        F.when(F.col(f"n{j}") >= 2, F.try_divide(f"d{j}", F.col(f"n{j}") * F.col(f"n{j}"))) for j in range(M.CLUSTERS)
    ]))
    centre = F.try_divide(F.aggregate("means", F.lit(0.0), lambda s, x: s + x), F.size("means"))
    squares = F.aggregate("means", F.lit(0.0), lambda s, x: s + (x - F.col("mu")) * (x - F.col("mu")))
    spread_of = F.sqrt(F.try_divide(squares, F.size("means")))
    kept = [F.col(f"`{c}`") for c in keep]
    return joined.select(*kept, entropy.alias("cand_cluster_size_entropy_k3"), means.alias("means")).withColumn(
        "mu", centre
    ).select(*kept, "cand_cluster_size_entropy_k3", F.when(F.size("means") > 0, spread_of).alias("ambiguous_cluster_score"))


# --- wide tables ------------------------------------------------------------------------------------

REC_FEATURES, IR_FEATURES = list(fv.REC_FEATURES), list(fv.IR_FEATURES)
UNSET_FOR_IR = ("cand_sim_>0.3_ratio", "cand_sim_>0.5_ratio", "cand_sim_>0.7_ratio")


def fill_zero(requests: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """All requests, with 0 where a feature could not be computed."""
    joined = requests.select("request_id").join(features, "request_id", "left")
    return joined.select("request_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in names])


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One row per request with the columns of all parts, which have no more than one row for a request: one shuffle for all."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("request_id").agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "request_id"])


def _only(features: DataFrame, allowed: DataFrame) -> DataFrame:
    return features.join(allowed, "request_id", "left_semi")


_MEASURE = {"adj": "adjacent", "pairwise": "pairs", "singular": "singular", "cluster": "clusters"}
_NEAR = ("history_candidate", "top", "cand_sim_>", "c2h", "cand_density")


def measure_of(name: str) -> str:
    """The measure that a recommendation feature is worked out from."""
    return next((m for mark, m in _MEASURE.items() if mark in name), "near" if name.startswith(_NEAR) else "parts")


def entry_features(entries: DataFrame, names: list[str]) -> DataFrame:
    """request_id and the named recommendation features, by way of blocks; NULL where there is none."""
    wanted = {measure_of(n) for n in names}
    table = materialise(blocks(usable(entries)), "vector-blocks", "section")
    prof = materialise(profile(table), "vector-profile")
    sided = prof.filter(both_sides()).select("request_id")
    made = {
        "parts": lambda: [spread(prof), drift(prof), centroids(prof)],
        "near": lambda: [candidate_history(table, prof)],
        "adjacent": lambda: [_only(adjacent(table), sided)],
        "pairs": lambda: [_only(pairwise(table), sided)],
        "singular": lambda: [
            _only(singular_sum(table, prof, "history", "hist", "hist_pca_singular_top3_sum"), sided),
            _only(singular_sum(table, prof, "candidate", "cand", "cand_pca_singular_top3_sum"), sided),
        ],
        "clusters": lambda: [_only(clusters(table), sided)],
    }
    wide = side_by_side([part for m, parts in made.items() if m in wanted for part in parts()])
    return wide.select("request_id", *[F.col(f"`{n}`") for n in names])


def rec_features(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The 36 recommendation features."""
    return fill_zero(requests, entry_features(entries, REC_FEATURES), REC_FEATURES)


def ir_sides(prof: DataFrame) -> DataFrame:
    c, q = F.col("cand.centroid"), F.col("query.centroid")
    return prof.filter(F.col("query").isNotNull() & F.col("cand").isNotNull()).select(
        "request_id",
        V.norm(q).alias("query_norm"),
        _variance("cand").alias("cand_embedding_dispersion"),
        _scatter("cand").alias("cand_cov_trace"),
        V.norm(c).alias("cand_centroid_norm"),
        _cosine(q, c).alias("qc_centroid_cos"),
        V.distance(c, q).alias("qc_centroid_dist"),
    )


def ir_features(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The 27 retrieval features; the threshold shares exist but stay 0 for retrieval."""
    table = materialise(blocks(usable(entries)), "vector-blocks", "section")
    prof = materialise(profile(table), "vector-profile")
    sides = ir_sides(prof)
    sided = sides.select("request_id")
    parts = [sides, candidate_query(table, prof).drop(*UNSET_FOR_IR)] + [
        _only(t, sided)
        for t in (
            pairwise(table), singular_sum(table, prof, "candidate", "cand", "cand_pca_singular_top3_sum"),
            clusters(table),
        )
    ]
    joined = side_by_side(parts)
    for c in UNSET_FOR_IR:
        joined = joined.withColumn(c, F.lit(0.0))
    return fill_zero(requests, joined, IR_FEATURES)
