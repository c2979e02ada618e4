"""Checks for the vector features, written as plain joins of all pairs."""

from routegauge.oracle.builder import cte, r6

_E = "1e-12::DOUBLE"


def cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}.v, {b}.v) / (({a}.nrm + {_E}) * ({b}.nrm + {_E})))"


def centroid_table(name: str, source: str, where: str = "true") -> None:
    cte(name, f"""
    SELECT request_id, list(m ORDER BY dim) AS v, sqrt(sum(m * m)) AS nrm FROM (
      SELECT request_id, dim, avg(val) AS m FROM (
        SELECT request_id, unnest(v) AS val, generate_subscripts(v, 1) AS dim FROM {source} WHERE {where})
      GROUP BY request_id, dim)
    GROUP BY request_id
    """)


cte("x_sized", "SELECT *, count(*) OVER (PARTITION BY request_id, section) AS n FROM x_entries")
cte("x_hist", "SELECT * FROM x_sized WHERE section = 'history'")
cte("x_cand", "SELECT * FROM x_sized WHERE section = 'candidate'")
cte("x_both", "SELECT DISTINCT request_id FROM x_hist WHERE request_id IN (SELECT request_id FROM x_cand)")
cte("x_dimvar", """
SELECT request_id, section, var_pop(val) AS cells, any_value(n) AS n FROM (
  SELECT request_id, section, n, unnest(v) AS val FROM x_sized) GROUP BY request_id, section
""")
cte("x_trace", """
SELECT request_id, section, sum(s) / greatest(any_value(n) - 1, 1) AS tr FROM (
  SELECT request_id, section, dim, any_value(n) AS n, var_pop(val) * count(*) AS s FROM (
    SELECT request_id, section, n, unnest(v) AS val, generate_subscripts(v, 1) AS dim FROM x_sized)
  GROUP BY request_id, section, dim) GROUP BY request_id, section
""")
centroid_table("x_hcent", "x_hist")
centroid_table("x_ccent", "x_cand")
centroid_table("x_early", "x_hist", "n >= 4 AND dpos < n // 2")
centroid_table("x_late", "x_hist", "n >= 4 AND dpos >= n // 2")
cte("x_adj", f"""
SELECT a.request_id, avg({cos('a', 'b')}) AS m, stddev_pop({cos('a', 'b')}) AS s
FROM x_hist a JOIN x_hist b ON b.request_id = a.request_id AND b.dpos = a.dpos + 1 GROUP BY a.request_id
""")
cte("x_pairs", f"""
SELECT a.request_id, avg({cos('a', 'b')}) AS m, stddev_pop({cos('a', 'b')}) AS s, min({cos('a', 'b')}) AS lo
FROM x_cand a JOIN x_cand b ON b.request_id = a.request_id AND a.dpos < b.dpos GROUP BY a.request_id
""")
cte("x_csim", f"""
SELECT c.request_id, c.dpos, avg({cos('c', 'h')}) AS sim, avg({cos('c', 'h')}) FILTER (WHERE h.dpos >= h.n - 3) AS recent
FROM x_cand c JOIN x_hist h ON h.request_id = c.request_id GROUP BY c.request_id, c.dpos
""")
cte("x_dens", """
SELECT c.request_id, avg(list_distance(c.v, h.v)) AS d FROM x_cand c JOIN x_hcent h ON h.request_id = c.request_id GROUP BY 1
""")


def simstats(table: str) -> str:
    return f"""
    SELECT request_id, max(sim) AS hi, avg(sim) AS me, min(sim) AS lo, var_pop(sim) AS va,
      quantile_cont(sim, 0.5) AS p50, quantile_cont(sim, 0.75) AS p75, quantile_cont(sim, 0.9) AS p90, quantile_cont(sim, 0.95) AS p95,
      list_reverse_sort(list(sim)) AS l, avg((sim > 0.3)::INT) AS r3, avg((sim > 0.5)::INT) AS r5, avg((sim > 0.7)::INT) AS r7
    FROM {table} GROUP BY request_id"""


cte("x_cstat", simstats("x_csim"))
cte("x_recent", "SELECT request_id, avg(recent) AS m, max(recent) AS hi FROM x_csim GROUP BY 1")

# --- retrieval --------------------------------------------------------------------------------------

cte("x_irq", "SELECT request_id, v, nrm FROM x_irentries WHERE section = 'query'")
cte("x_irc", "SELECT * FROM x_irentries WHERE section = 'candidate'")
centroid_table("x_ircent", "x_irc")
cte("x_irsim", f"""
SELECT c.request_id, c.dpos, {cos('c', 'q')} AS sim, list_distance(c.v, q.v) AS d
FROM x_irc c JOIN x_irq q ON q.request_id = c.request_id
""")
cte("x_irstat", simstats("x_irsim"))
cte("x_irpairs", f"""
SELECT a.request_id, avg({cos('a', 'b')}) AS m, stddev_pop({cos('a', 'b')}) AS s, min({cos('a', 'b')}) AS lo
FROM x_irc a JOIN x_irc b ON b.request_id = a.request_id AND a.dpos < b.dpos
WHERE a.request_id IN (SELECT request_id FROM x_irq) GROUP BY a.request_id
""")
cte("x_irdens", "SELECT request_id, avg(d) AS d FROM x_irsim GROUP BY 1")
cte("x_irvar", """
SELECT request_id, sum(s) / greatest(any_value(n) - 1, 1) AS tr, any_value(cells) AS cells FROM (
  SELECT request_id, dim, count(*) AS n, var_pop(val) * count(*) AS s FROM (
    SELECT request_id, unnest(v) AS val, generate_subscripts(v, 1) AS dim FROM x_irc) GROUP BY request_id, dim)
JOIN (SELECT request_id, var_pop(val) AS cells FROM (SELECT request_id, unnest(v) AS val FROM x_irc) GROUP BY 1) USING (request_id)
GROUP BY request_id
""")
cte("x_irall", "SELECT vec_id AS request_id FROM embeddings")


def cols(pairs: dict[str, str]) -> str:
    return ", ".join(f'{r6(f"coalesce({expr}, 0)")} AS "{name}"' for name, expr in pairs.items())


_SIM = {f"history_candidate_sim_{n}": f"s.{c}" for n, c in
        (("max", "hi"), ("mean", "me"), ("min", "lo"), ("var", "va"), ("p50", "p50"), ("p75", "p75"), ("p90", "p90"), ("p95", "p95"))}
_TOP = {
    "top1_sim": "s.l[1]", "top10_sim": "s.l[least(10, len(s.l))]", "top_k_sim_gap": "s.l[1] - s.l[least(10, len(s.l))]",
    "history_candidate_sim_top1_top2_gap": "s.l[1] - s.l[2]",
    "cand_sim_>0.3_ratio": "s.r3", "cand_sim_>0.5_ratio": "s.r5", "cand_sim_>0.7_ratio": "s.r7",
}
_IR = {f"query_candidate_sim_{n}": f"s.{c}" for n, c in
       (("max", "hi"), ("mean", "me"), ("min", "lo"), ("var", "va"), ("p50", "p50"), ("p75", "p75"), ("p90", "p90"), ("p95", "p95"))}
_IR |= {
    "top1_sim": "s.l[1]", "top10_sim": "s.l[least(10, len(s.l))]", "top_k_sim_gap": "s.l[1] - s.l[least(10, len(s.l))]",
    "query_norm": "CASE WHEN s.hi IS NOT NULL THEN q.nrm END", "cand_embedding_dispersion": "CASE WHEN s.hi IS NOT NULL THEN w.cells END",
    "cand_cov_trace": "CASE WHEN s.hi IS NOT NULL THEN w.tr END", "cand_centroid_norm": "CASE WHEN s.hi IS NOT NULL THEN c.nrm END",
    "qc_centroid_cos": cos("q", "c"), "qc_centroid_dist": "list_distance(q.v, c.v)", "cand_density_wrt_query": "d.d",
}

FEATURES = {
    "vec_spread": "SELECT r.request_id, " + cols({
        "hist_len": "h.n", "hist_embedding_variance": "h.cells", "cand_embedding_dispersion": "c.cells",
        "hist_cov_trace": "CASE WHEN b.request_id IS NOT NULL THEN ht.tr END",
        "cand_cov_trace": "CASE WHEN b.request_id IS NOT NULL THEN ct.tr END",
    }) + """ FROM x_req r LEFT JOIN x_both b ON b.request_id = r.request_id
        LEFT JOIN x_dimvar h ON h.request_id = r.request_id AND h.section = 'history'
        LEFT JOIN x_dimvar c ON c.request_id = r.request_id AND c.section = 'candidate'
        LEFT JOIN x_trace ht ON ht.request_id = r.request_id AND ht.section = 'history'
        LEFT JOIN x_trace ct ON ct.request_id = r.request_id AND ct.section = 'candidate'""",
    "hist_adjacent": "SELECT r.request_id, " + cols({"hist_adj_cos_mean": "a.m", "hist_adj_cos_std": "a.s"})
        + " FROM x_req r LEFT JOIN x_adj a ON a.request_id = r.request_id AND a.request_id IN (SELECT request_id FROM x_both)",
    "hist_drift": "SELECT r.request_id, " + cols({"hist_drift_cos": cos("a", "b")})
        + """ FROM x_req r LEFT JOIN x_early a ON a.request_id = r.request_id AND a.request_id IN (SELECT request_id FROM x_both)
        LEFT JOIN x_late b ON b.request_id = a.request_id""",
    "cand_pairwise": "SELECT r.request_id, " + cols({
        "cand_pairwise_cos_mean": "p.m", "cand_pairwise_cos_std": "p.s", "cand_pairwise_cos_min": "p.lo",
    }) + " FROM x_req r LEFT JOIN x_pairs p ON p.request_id = r.request_id AND p.request_id IN (SELECT request_id FROM x_both)",
    "hist_cand_sim": f"SELECT r.request_id, {cols(_SIM)} FROM x_req r LEFT JOIN x_cstat s ON s.request_id = r.request_id",
    "sim_topk": f"SELECT r.request_id, {cols(_TOP)} FROM x_req r LEFT JOIN x_cstat s ON s.request_id = r.request_id",
    "recent_sim": "SELECT r.request_id, " + cols({"c2h_recentK_mean": "c.m", "c2h_recentK_max": "c.hi"})
        + " FROM x_req r LEFT JOIN x_recent c ON c.request_id = r.request_id",
    "centroid_feats": "SELECT r.request_id, " + cols({
        "hist_cand_centroid_cos": cos("h", "c"), "hist_cand_centroid_dist": "list_distance(h.v, c.v)",
        "cand_centroid_norm": "c.nrm", "cand_density_wrt_hist": "d.d",
    }) + """ FROM x_req r LEFT JOIN x_hcent h ON h.request_id = r.request_id AND h.request_id IN (SELECT request_id FROM x_both)
        LEFT JOIN x_ccent c ON c.request_id = h.request_id LEFT JOIN x_dens d ON d.request_id = h.request_id""",
    "query_cand_sim": f"""SELECT r.request_id, {cols(_IR)} FROM x_irall r LEFT JOIN x_irstat s ON s.request_id = r.request_id
        LEFT JOIN x_irq q ON q.request_id = r.request_id LEFT JOIN x_ircent c ON c.request_id = r.request_id
        LEFT JOIN x_irvar w ON w.request_id = r.request_id LEFT JOIN x_irdens d ON d.request_id = r.request_id""",
}

_REC_PARTS = ["hist_adjacent", "hist_drift", "cand_pairwise", "hist_cand_sim", "sim_topk", "recent_sim", "centroid_feats"]
FEATURES["rec_features_stated"] = f"SELECT * FROM ({FEATURES['vec_spread']}) " + " ".join(
    f"JOIN ({FEATURES[name]}) USING (request_id)" for name in _REC_PARTS
)
_IR_PAIRS = cols({"cand_pairwise_cos_mean": "p.m", "cand_pairwise_cos_std": "p.s", "cand_pairwise_cos_min": "p.lo"})
FEATURES["ir_features_stated"] = f"""
    SELECT *, {cols({f'cand_sim_>{t}_ratio': '0' for t in ('0.3', '0.5', '0.7')})} FROM ({FEATURES['query_cand_sim']})
    JOIN (SELECT r.request_id, {_IR_PAIRS} FROM x_irall r LEFT JOIN x_irpairs p ON p.request_id = r.request_id) USING (request_id)"""
FEATURES["entry_file_features"] = FEATURES["ir_features_stated"]
FEATURES["catalogue_files"] = """
    SELECT 'lines' AS file, item_id::BIGINT AS item_id, title, genres FROM x_items
    UNION ALL SELECT 'csv', item_id::BIGINT, title, NULL FROM x_items"""
