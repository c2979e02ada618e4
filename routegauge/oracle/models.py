"""Checks for checklist features, bundles and calibration."""

from routegauge import fixed_values as fv
from routegauge.oracle.builder import cte, h, r6

_VARIANTS = ", ".join(
    f"('{name}', '{side}', {i}, '{variant.strip()}')"
    for name, sides in fv.VERBALIZERS.items() for side, variants in sides.items() for i, variant in enumerate(variants)
)
cte("x_known", f"""
SELECT vs, side, min(no) AS no, {h('word')} % (SELECT n FROM x_nemb) AS token_id FROM (VALUES {_VARIANTS}) t(vs, side, no, word)
WHERE word IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) FROM documents) GROUP BY vs, side, word
""")
cte("x_vset", """
SELECT vs, side, token_id, min(no) AS no FROM x_known k
WHERE (SELECT count(DISTINCT side) FROM x_known o WHERE o.vs = k.vs) = 2 GROUP BY vs, side, token_id
""")
cte("x_hidden", """
SELECT r.request_id, q::INT AS q, side, e.v FROM (
  SELECT request_id, q, side, request_id * 20 + q * 2 + s AS k FROM x_req, range(1, 11) g(q), (VALUES ('dir', 0), ('cot', 1)) t(side, s)
  UNION ALL SELECT request_id, 0, 'neutral', request_id FROM x_req) r
JOIN x_emb e ON e.vec_id = r.k % (SELECT n FROM x_nemb)
""")
cte("x_weights", """
SELECT s.vs, s.side = 'yes' AS yes, e.v AS w, e.vec_id % 16 / 100.0::DOUBLE AS b
FROM x_vset s JOIN x_emb e ON e.vec_id = s.token_id
""")
cte("x_margin", """
SELECT request_id, q, side, vs, ln(sum(exp(z)) FILTER (WHERE yes)) - ln(sum(exp(z)) FILTER (WHERE NOT yes)) AS m FROM (
  SELECT request_id, q, side, vs, yes, list_dot_product(h.v, w.w) + w.b AS z FROM x_hidden h, x_weights w)
GROUP BY request_id, q, side, vs
""")
cte("x_question", """
SELECT request_id, q, max(p) FILTER (WHERE side = 'dir') AS p_dir, max(p) FILTER (WHERE side = 'cot') AS p_cot,
  max(raw) FILTER (WHERE side = 'dir') - max(raw) FILTER (WHERE side = 'cot') AS margin_raw FROM (
  SELECT a.request_id, a.q, a.side, avg(1 / (1 + exp(-(a.m - n.m)))) AS p, avg(a.m - n.m) AS raw
  FROM x_margin a JOIN x_margin n ON n.request_id = a.request_id AND n.vs = a.vs AND n.q = 0 WHERE a.q > 0
  GROUP BY a.request_id, a.q, a.side)
GROUP BY request_id, q
""")
cte("x_qagg", """
SELECT request_id, avg(p_dir) AS dir_mean, avg(p_cot) AS cot_mean, avg(margin_raw) AS margin_mean_raw,
  count(*) FILTER (WHERE margin_raw > 0) AS win_count, avg(margin_raw) FILTER (WHERE nth <= 3) AS top3
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY abs(margin_raw) DESC, q DESC) AS nth FROM x_question)
GROUP BY request_id
""")
_PIVOT = ", ".join(f"{r6(f'max(margin_raw) FILTER (WHERE q = {i})')} AS mraw_q{i}" for i in range(1, 11))
cte("x_qleft", f"""
SELECT request_id, {_PIVOT}, avg(margin_raw) AS me, count(*) FILTER (WHERE margin_raw > 0) AS wins,
  avg(margin_raw) FILTER (WHERE nth <= 3) AS low, avg(p_dir) - avg(p_cot) AS gap
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY margin_raw) AS nth FROM x_question
      WHERE NOT (request_id % 13 = 0 AND q = 7))
GROUP BY request_id
""")

# --- features ---------------------------------------------------------------------------------------

cte("x_pop", "SELECT l_partkey AS item_id, count(*) AS bought FROM lineitem GROUP BY 1")
cte("x_context", """
SELECT r.request_id, h.pop AS hp, c.pop AS cp, e.ent FROM x_req r
LEFT JOIN (SELECT request_id, avg(coalesce(bought, 0)) AS pop FROM x_history LEFT JOIN x_pop USING (item_id) GROUP BY 1) h USING (request_id)
LEFT JOIN (SELECT request_id, avg(coalesce(bought, 0)) AS pop FROM x_cands LEFT JOIN x_pop USING (item_id) GROUP BY 1) c USING (request_id)
LEFT JOIN (SELECT request_id, entropy(genres) * ln(2) AS ent FROM x_history JOIN x_items USING (item_id) GROUP BY 1) e USING (request_id)
""")
cte("x_feat", """
SELECT r.request_id, (SELECT count(*) FROM x_history h WHERE h.request_id = r.request_id)::DOUBLE AS hist_len, x.ent AS history_genre_entropy,
  x.cp AS candidate_avg_popularity, x.hp AS history_avg_popularity, q.dir_mean - q.cot_mean AS gap_mean, q.margin_mean_raw,
  q.win_count::DOUBLE AS win_count, q.top3 AS top3_margin_mean
FROM x_req r JOIN x_context x ON x.request_id = r.request_id JOIN x_qagg q ON q.request_id = r.request_id
""")
_FEATURES = [
    "hist_len", "history_genre_entropy", "candidate_avg_popularity", "history_avg_popularity", "gap_mean", "margin_mean_raw",
    "win_count", "top3_margin_mean",
]
_ROUNDED = ", ".join(f"{r6('f.' + c)} AS {c}" for c in _FEATURES)


def _mean(metric: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {metric}_{i} = -1 THEN 0 ELSE {metric}_{i} END" for i in range(1, 6)) + ") / 5"


cte("x_bundle", f"""
SELECT w.request_id, s.split, w.mode, {_mean('ndcg10')} AS nd, {_mean('recall10')} AS re, t.avg_tokens AS tk
FROM x_wide w JOIN x_tokens t ON t.request_id = w.request_id AND t.mode = w.mode JOIN x_split s ON s.request_id = w.request_id
""")

# --- calibration ------------------------------------------------------------------------------------

cte("x_steps", "SELECT score, count(*) AS w, avg(adv) AS y FROM x_core GROUP BY 1")
cte("x_sums", """
SELECT score, w, row_number() OVER (ORDER BY score) AS i, sum(w) OVER (ORDER BY score) AS cw, sum(w * y) OVER (ORDER BY score) AS cy FROM x_steps
""")
cte("x_lowest", """
SELECT j.i AS j, k.i AS i, min((k.cy - coalesce(b.cy, 0)) / (k.cw - coalesce(b.cw, 0))) OVER (PARTITION BY j.i ORDER BY k.i DESC) AS lo
FROM x_sums j JOIN x_sums k ON k.i >= j.i LEFT JOIN x_sums b ON b.i = j.i - 1
""")

# --- boosting ---------------------------------------------------------------------------------------

_INPUTS = ", ".join(f"('{c}', coalesce(f.{c}, 0)::DOUBLE)" for c in _FEATURES) + ", ('delta_tokens_mean', t.tok_c - t.tok_d)"
cte("x_boost", f"""
SELECT t.request_id, adv, weight, feature, x FROM x_train t JOIN x_feat f ON f.request_id = t.request_id, LATERAL (VALUES {_INPUTS}) v(feature, x)
""")
cte("x_ends", "SELECT feature, min(x) AS lo, max(x) AS hi FROM x_boost GROUP BY 1")
cte("x_start", "SELECT sum(weight * adv) / sum(weight) AS start FROM x_train")
cte("x_firstsums", """
SELECT feature, len(list_filter(range(1, 16), lambda i: lo + (hi - lo) * (i / 16::DOUBLE) < x))::INT AS bin,
  sum(weight * (start - adv)) AS g, sum(weight) AS h, count(*) AS n
FROM x_boost JOIN x_ends USING (feature), x_start GROUP BY 1, 2
""")
cte("x_sides", """
SELECT a.feature, a.bin, sum(b.g) FILTER (WHERE b.bin <= a.bin) AS gl, sum(b.h) FILTER (WHERE b.bin <= a.bin) AS hl,
  sum(b.n) FILTER (WHERE b.bin <= a.bin) AS nl, coalesce(sum(b.g) FILTER (WHERE b.bin > a.bin), 0) AS gr,
  coalesce(sum(b.h) FILTER (WHERE b.bin > a.bin), 0) AS hr, coalesce(sum(b.n) FILTER (WHERE b.bin > a.bin), 0) AS nr
FROM x_firstsums a JOIN x_firstsums b USING (feature) GROUP BY 1, 2
""")
cte("x_firstsplit", """
SELECT * FROM x_sides WHERE least(nl, nr) >= 20
ORDER BY gl * gl / (hl + 1e-4::DOUBLE) + gr * gr / (hr + 1e-4::DOUBLE) DESC, bin LIMIT 1
""")
cte("x_folds", f"""
SELECT adv, weight, {h("request_id || ':0'")} % 5 AS fold, {h("request_id || ':stop-0'")} % 10 = 0 AS stops FROM x_train
""")


def _five(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 5) + 0.0::DOUBLE)"


MODELS = {
    "checklist_margin": f'SELECT request_id, q, side, vs AS "set", {r6("m")} AS margin FROM x_margin',
    "checklist_probs": f"""SELECT request_id, q, {r6('p_dir')} AS p_dir, {r6('p_cot')} AS p_cot, {r6('margin_raw')} AS margin_raw,
        {r6('p_dir - p_cot')} AS margin FROM x_question""",
    "checklist_agg": f"""SELECT request_id, {r6('dir_mean')} AS dir_mean, {r6('cot_mean')} AS cot_mean, {r6('dir_mean - cot_mean')} AS gap_mean,
        {r6('margin_mean_raw')} AS margin_mean_raw, {r6('win_count')} AS win_count, {r6('top3')} AS top3_margin_mean FROM x_qagg""",
    "checklist_select": f"""
        SELECT l.request_id, {', '.join(f'mraw_q{i}' for i in range(1, 11))},
          {r6('CASE WHEN l.request_id % 2 = 0 THEN a.margin_mean_raw ELSE me END')} AS margin_mean_raw,
          {r6('CASE WHEN l.request_id % 2 = 0 THEN a.win_count ELSE wins END')} AS win_count,
          {r6('CASE WHEN l.request_id % 2 = 0 THEN a.top3 ELSE low END')} AS top3_margin_mean,
          {r6('CASE WHEN l.request_id % 2 = 0 THEN a.dir_mean - a.cot_mean ELSE gap END')} AS gap_mean
        FROM x_qleft l JOIN x_qagg a ON a.request_id = l.request_id""",
    "merge_features": f"SELECT request_id, {_ROUNDED} FROM x_feat f",
    "bundle": f"""
        SELECT d.request_id, d.split, {r6('d.nd')} AS direct_mean_ndcg, {r6('d.re')} AS direct_mean_recall, {r6('d.tk')} AS direct_avg_tokens,
          {r6('c.nd')} AS cot_mean_ndcg, {r6('c.re')} AS cot_mean_recall, {r6('c.tk')} AS cot_avg_tokens,
          {r6('c.tk - d.tk')} AS delta_tokens_mean, {_ROUNDED}
        FROM x_bundle d JOIN x_bundle c ON c.request_id = d.request_id AND c.mode = 'cot' AND d.mode = 'direct'
        JOIN x_feat f ON f.request_id = d.request_id""",
    "select_features": f"""
        SELECT f.request_id, {r6('gap_mean')} AS gap_mean, {r6('hist_len')} AS hist_len, {r6('c.avg_tokens - d.avg_tokens')} AS delta_tokens_mean
        FROM x_feat f JOIN x_tokens d ON d.request_id = f.request_id AND d.mode = 'direct'
        JOIN x_tokens c ON c.request_id = f.request_id AND c.mode = 'cot'""",
    "isotonic": f"""
        SELECT score, any_value(w)::DOUBLE AS weight, {r6('max(lo)')} AS calibrated
        FROM x_sums s JOIN x_lowest l ON l.i = s.i GROUP BY score""",
    "write_entries": """
        SELECT section, count(*) AS rows,
          count(*) FILTER (WHERE item_id % 101 <> 5 AND NOT (section = 'history' AND request_id % 97 = 3)) AS with_vector FROM (
          SELECT 'history' AS section, request_id, item_id FROM x_history UNION ALL SELECT 'candidate', request_id, item_id FROM x_cands)
        GROUP BY section""",
}

MODELS["verbalizer_sets"] = """
    SELECT vs AS "set", side, (row_number() OVER (PARTITION BY vs, side ORDER BY no) - 1)::INT AS pos, token_id FROM x_vset"""
MODELS["boost_parts"] = f"""
    SELECT m::INT AS model, count(*) FILTER (WHERE NOT stops) AS train_rows, count(*) FILTER (WHERE stops) AS stop_rows,
      {r6("avg(adv) FILTER (WHERE NOT stops)")} AS start,
      {r6("sum(weight * adv) FILTER (WHERE NOT stops) / sum(weight) FILTER (WHERE NOT stops)")} AS weighted_start
    FROM x_folds, range(0, 6) r(m) WHERE m <> fold GROUP BY 1"""
MODELS["boost_first_sums"] = f"SELECT feature, bin, {_five('g')} AS g, {_five('h')} AS h, n FROM x_firstsums"
MODELS["boost_first_split"] = " UNION ALL ".join(
    f"""SELECT feature, bin, '{side}' AS side, n{side[0]}::BIGINT AS n, {_five(f'-g{side[0]} / (h{side[0]} + 1e-4::DOUBLE)')} AS leaf,
      {_five('start')} AS start FROM x_firstsplit, x_start"""
    for side in ("left", "right")
)
MODELS["entries_npz"] = MODELS["write_entries"].replace(" AS rows,", " AS rows, count(DISTINCT request_id) AS requests,")
