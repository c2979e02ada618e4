"""Vector features against NumPy, on one block and with blocks, and chunks made tiny."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge.functions import matrices as M
from routegauge.operators import vector_features as E

DIM = 6


def entries(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for request, (h, c) in sizes.items():
        for section, n in (("history", h), ("candidate", c)):
            kept = []
            for pos in range(n):
                v = rng.normal(size=DIM).astype(np.float32) + 0.5
                missing = pos % 7 == 5
                rows.append((request, section, pos, pos, None if missing else v.tolist()))
                if not missing:
                    kept.append(v.astype(np.float64))
            truth[request, section] = np.array(kept).reshape(-1, DIM)
    schema = "request_id bigint, section string, pos int, item_id bigint, vec array<float>"
    return spark.createDataFrame(rows, schema), truth


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def expected(H, C):
    out = {"hist_len": float(len(H)), "hist_embedding_variance": H.var() if H.size else 0.0, "cand_embedding_dispersion": C.var() if C.size else 0.0}
    if not H.size or not C.size:
        return out
    for name, X in (("hist", H), ("cand", C)):
        Xc = X - X.mean(axis=0)
        out[f"{name}_cov_trace"] = np.square(Xc).sum() / max(len(X) - 1, 1)
        out[f"{name}_pca_singular_top3_sum"] = np.linalg.svd(Xc, compute_uv=False)[:3].sum()
    Hn, Cn = unit(H), unit(C)
    if len(H) >= 2:
        adj = (Hn[:-1] * Hn[1:]).sum(axis=1)
        out |= {"hist_adj_cos_mean": adj.mean(), "hist_adj_cos_std": adj.std()}
    if len(H) >= 4:
        a, b = H[: len(H) // 2].mean(axis=0), H[len(H) // 2:].mean(axis=0)
        out["hist_drift_cos"] = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    if len(C) >= 2:
        pairs = (Cn @ Cn.T)[np.triu_indices(len(C), 1)]
        out |= {"cand_pairwise_cos_mean": pairs.mean(), "cand_pairwise_cos_std": pairs.std(), "cand_pairwise_cos_min": pairs.min()}
    sims = (Cn @ Hn.T).mean(axis=1)
    p = "history_candidate_sim_"
    out |= {p + "max": sims.max(), p + "mean": sims.mean(), p + "min": sims.min(), p + "var": sims.var()}
    out |= {p + f"p{q}": np.quantile(sims, q / 100) for q in (50, 75, 90, 95)}
    top = np.sort(sims)[::-1]
    out |= {"top1_sim": top[0], "top10_sim": top[min(9, len(top) - 1)], "top_k_sim_gap": top[0] - top[min(9, len(top) - 1)]}
    if len(top) > 1:
        out[p + "top1_top2_gap"] = top[0] - top[1]
    out |= {f"cand_sim_>{t}_ratio": (sims > t).mean() for t in (0.3, 0.5, 0.7)}
    recent = (Cn @ Hn[-3:].T).mean(axis=1)
    hc, cc = H.mean(axis=0), C.mean(axis=0)
    out |= {
        "c2h_recentK_mean": recent.mean(), "c2h_recentK_max": recent.max(), "cand_centroid_norm": np.linalg.norm(cc),
        "hist_cand_centroid_cos": hc @ cc / np.linalg.norm(hc) / np.linalg.norm(cc), "hist_cand_centroid_dist": np.linalg.norm(cc - hc),
        "cand_density_wrt_hist": np.linalg.norm(C - hc, axis=1).mean(),
    }
    if len(C) >= 3:
        labels = M.lloyd(C)
        means, sizes = [], np.bincount(labels, minlength=3)
        for j in range(3):
            if sizes[j] >= 2:
                X = C[labels == j]
                means.append(np.linalg.norm(X[:, None] - X[None], axis=2).mean())
        share = sizes[sizes > 0] / sizes.sum()
        out |= {"ambiguous_cluster_score": np.std(means) if means else 0.0, "cand_cluster_size_entropy_k3": -(share * np.log(share)).sum()}
    return out


SIZES = {1: (12, 20), 2: (1, 1), 3: (0, 4), 4: (3, 2), 5: (45, 61), 6: (5, 0)}


@pytest.mark.parametrize("tiny", [False, True])
def test_rec_features_match_numpy(spark, monkeypatch, tiny):
    if tiny:  # several blocks, chunks and value buckets per request
        monkeypatch.setattr(E, "BLOCK", 8)
        monkeypatch.setattr(E, "CHUNK", 5)
    df, truth = entries(spark, SIZES)
    req = spark.createDataFrame([(r,) for r in SIZES], "request_id bigint")
    got = {r["request_id"]: r.asDict() for r in E.rec_features(req, df).collect()}
    assert set(got) == set(SIZES)
    for request in SIZES:
        want = expected(truth[request, "history"], truth[request, "candidate"])
        for name in E.REC_FEATURES:
            assert got[request][name] == pytest.approx(want.get(name, 0.0), abs=1e-6), (request, name)


def test_feature_counts():
    assert len(E.REC_FEATURES) == 36 and len(E.IR_FEATURES) == 27


def test_ir_features_without_query_are_zero(spark):
    df, truth = entries(spark, {1: (0, 12), 2: (0, 3)})
    query = spark.createDataFrame([(1, "query", 0, 0, [1.0] * DIM)], "request_id bigint, section string, pos int, item_id bigint, vec array<float>")
    req = spark.createDataFrame([(1,), (2,)], "request_id bigint")
    got = {r["request_id"]: r.asDict() for r in E.ir_features(req, df.unionByName(query)).collect()}
    C, q = truth[1, "candidate"], np.ones(DIM)
    sims = unit(C) @ (q / np.linalg.norm(q))
    assert got[1]["query_candidate_sim_max"] == pytest.approx(sims.max())
    assert got[1]["query_candidate_sim_p90"] == pytest.approx(np.quantile(sims, 0.9))
    assert got[1]["query_norm"] == pytest.approx(np.linalg.norm(q))
    assert got[1]["cand_density_wrt_query"] == pytest.approx(np.linalg.norm(C - q, axis=1).mean())
    assert got[1]["cand_sim_>0.3_ratio"] == 0.0
    assert all(v == 0.0 for k, v in got[2].items() if k != "request_id")
