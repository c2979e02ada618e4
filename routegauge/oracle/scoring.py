"""Checks for answers, metrics and the comparison of modes."""

from routegauge import fixed_values as fv
from routegauge.oracle.builder import cte, h, r6, re2

_TAG, _INLINE, _BARE, _BRACKET = (re2(p) for p in (fv.REC_TAGGED, fv.REC_INLINE, fv.REC_BARE_LIST, fv.REC_BRACKET))
_IR_TAG, _IR_ID = re2(fv.IR_TAGGED), re2(fv.IR_BRACKET_ID)

cte("x_ids", rf"""
WITH bodies AS (
  SELECT request_id, mode, run, CASE
    WHEN regexp_matches(text, '{_TAG}') THEN regexp_extract(text, '{_TAG}', 1) || regexp_extract(text, '{_TAG}', 2)
    WHEN regexp_matches(text, '{_INLINE}') THEN regexp_extract(text, '{_INLINE}', 1) || regexp_extract(text, '{_INLINE}', 2)
    WHEN regexp_matches(text, '{_BARE}') THEN text
    ELSE regexp_extract(text, '{_BRACKET}', 1) END AS body
  FROM x_runs),
listed AS (SELECT request_id, mode, run, regexp_extract_all(body, '\d+') AS ids FROM bodies),
flat AS (SELECT request_id, mode, run, unnest(ids)::BIGINT AS item_id, generate_subscripts(ids, 1) AS p FROM listed),
firsts AS (SELECT request_id, mode, run, item_id, min(p) AS p FROM flat GROUP BY ALL)
SELECT request_id, mode, run, item_id,
       (row_number() OVER (PARTITION BY request_id, mode, run ORDER BY p) - 1)::INT AS pos
FROM firsts
""")

cte("x_runscore", """
WITH hits AS (
  SELECT i.request_id, i.mode, i.run, count(*) AS n,
    coalesce(sum(1 / log2(i.pos + 2)) FILTER (WHERE t.item_id IS NOT NULL AND i.pos < 10), 0) AS d10,
    coalesce(sum(1 / log2(i.pos + 2)) FILTER (WHERE t.item_id IS NOT NULL AND i.pos < 5), 0) AS d5,
    count(t.item_id) FILTER (WHERE i.pos < 10) AS h10, count(t.item_id) FILTER (WHERE i.pos < 5) AS h5
  FROM x_ids i LEFT JOIN x_truth t ON t.request_id = i.request_id AND t.item_id = i.item_id GROUP BY ALL),
sized AS (SELECT request_id, count(DISTINCT item_id) AS m FROM x_truth GROUP BY 1),
ideal AS (SELECT m, sum(1 / log2(i + 2)) AS v FROM range(1, 11) a(m), range(10) b(i) WHERE i < m GROUP BY m)
SELECT r.request_id, r.mode, r.run, h.d10 / a.v AS ndcg10, h.d5 / b.v AS ndcg5,
       h.h10::DOUBLE / s.m AS recall10, h.h5::DOUBLE / s.m AS recall5, r.num_tokens
FROM x_runs r JOIN sized s ON s.request_id = r.request_id
LEFT JOIN hits h ON h.request_id = r.request_id AND h.mode = r.mode AND h.run = r.run
LEFT JOIN ideal a ON a.m = least(s.m, h.n, 10) LEFT JOIN ideal b ON b.m = least(s.m, h.n, 5)
""")

_CELLS = ",\n".join(
    f"coalesce(max({m}) FILTER (WHERE run = {i}), -1.0::DOUBLE) AS {m}_{i}"
    for m in ("recall10", "ndcg10")
    for i in range(1, 6)
)
cte("x_asked", "SELECT request_id, mode FROM x_req, (VALUES ('direct'), ('cot')) m(mode)")
cte("x_wide", f"""
SELECT q.request_id, q.mode, {_CELLS},
  coalesce(avg(recall5), 0) AS "avg_recall@5", coalesce(avg(ndcg5), 0) AS "avg_ndcg@5",
  coalesce(avg(recall10) FILTER (WHERE run <= 5), 0) AS "avg_recall@10",
  coalesce(avg(ndcg10) FILTER (WHERE run <= 5), 0) AS "avg_ndcg@10"
FROM x_asked q LEFT JOIN x_runscore s ON s.request_id = q.request_id AND s.mode = q.mode GROUP BY q.request_id, q.mode
""")
cte("x_tokens", """
SELECT q.request_id, q.mode, coalesce(avg(coalesce(num_tokens, 0)) FILTER (WHERE run IS NOT NULL), 0) AS avg_tokens
FROM x_asked q LEFT JOIN x_runs r ON r.request_id = q.request_id AND r.mode = q.mode GROUP BY q.request_id, q.mode
""")

_WIDE_COLS = [f"{m}_{i}" for m in ("recall10", "ndcg10") for i in range(1, 6)] + [
    "avg_recall@5", "avg_ndcg@5", "avg_recall@10", "avg_ndcg@10"
]


def _zero(c: str) -> str:
    return f'(CASE WHEN "{c}" = -1 THEN 0 ELSE "{c}" END)'


def _mean(metric: str) -> str:
    return "((" + " + ".join(_zero(f"{metric}_{i}") for i in range(1, 6)) + ") / 5.0::DOUBLE)"


cte("x_stable", """
SELECT d.request_id, round(c."avg_ndcg@10", 9) AS c_ndcg, round(d."avg_ndcg@10", 9) AS d_ndcg,
       round(ct.avg_tokens, 9) AS c_tok, round(dt.avg_tokens, 9) AS d_tok
FROM x_wide d JOIN x_wide c ON c.request_id = d.request_id AND c.mode = 'cot' AND d.mode = 'direct'
JOIN x_tokens dt ON dt.request_id = d.request_id AND dt.mode = 'direct'
JOIN x_tokens ct ON ct.request_id = d.request_id AND ct.mode = 'cot'
""")

# --- retrieval --------------------------------------------------------------------------------------

cte("x_irids", f"""
WITH bodies AS (
  SELECT request_id, mode, run, CASE WHEN regexp_matches(text, '{_IR_TAG}')
    THEN regexp_extract(text, '{_IR_TAG}', 1) ELSE text END AS body FROM x_irruns),
listed AS (SELECT request_id, mode, run, regexp_extract_all(body, '{_IR_ID}', 1) AS ids FROM bodies),
flat AS (SELECT request_id, mode, run, upper(unnest(ids)) AS passage, generate_subscripts(ids, 1) AS p FROM listed),
firsts AS (SELECT request_id, mode, run, passage, min(p) AS p FROM flat GROUP BY ALL)
SELECT request_id, mode, run, passage,
       (row_number() OVER (PARTITION BY request_id, mode, run ORDER BY p) - 1)::INT AS pos
FROM firsts
""")
cte("x_irorder", f"""
SELECT request_id, upper(unnest(ids)) AS passage, generate_subscripts(ids, 1) - 1 AS pos
FROM (SELECT request_id, regexp_extract_all(ground_truth, '{_IR_ID}', 1) AS ids FROM x_irtruth)
""")
cte("x_irsize", "SELECT request_id, count(*) AS m FROM x_irorder GROUP BY 1")
cte("x_irrank", """
SELECT o.request_id, passage, max(pos) AS rg, max(s.m) - max(pos) AS rel
FROM x_irorder o JOIN x_irsize s ON s.request_id = o.request_id GROUP BY ALL
""")
cte("x_irhit", """
SELECT i.request_id, i.mode, i.run, i.pos, i.passage, k.rg, coalesce(k.rel, 0) AS rel
FROM x_irids i LEFT JOIN x_irrank k ON k.request_id = i.request_id AND k.passage = i.passage
""")
cte("x_irideal", """
SELECT o.request_id, k.rel, row_number() OVER (PARTITION BY o.request_id ORDER BY k.rel DESC) - 1 AS pos
FROM x_irorder o JOIN x_irrank k ON k.request_id = o.request_id AND k.passage = o.passage
""")


def _ir_ndcg(k: str, gain: str) -> str:
    """Body of a per-run graded ndcg; k may refer to the length n of the prediction."""
    return f"""
    SELECT r.request_id, r.mode, r.run, coalesce(g.v / nullif(b.v, 0), 0) AS v FROM x_irruns r
    LEFT JOIN (SELECT h.request_id, h.mode, h.run, 
               coalesce(sum({gain.format('h.rel')} / log2(h.pos + 2)) FILTER (WHERE h.pos < {k}), 0) AS v
               FROM x_irhit h JOIN x_irlen l USING (request_id, mode, run)
               GROUP BY h.request_id, h.mode, h.run) g
      ON g.request_id = r.request_id AND g.mode = r.mode AND g.run = r.run
    LEFT JOIN (SELECT l.request_id, l.mode, l.run, 
               sum({gain.format('i.rel')} / log2(i.pos + 2)) FILTER (WHERE i.pos < {k}) AS v
               FROM x_irlen l JOIN x_irideal i ON i.request_id = l.request_id
               GROUP BY l.request_id, l.mode, l.run) b
      ON b.request_id = r.request_id AND b.mode = r.mode AND b.run = r.run"""


cte("x_irlen", "SELECT request_id, mode, run, count(*) AS n FROM x_irids GROUP BY ALL")
cte("x_irtop1", """
SELECT r.request_id, r.mode, r.run, CASE WHEN p.passage = t.passage THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v
FROM x_irruns r LEFT JOIN x_irids p ON p.request_id = r.request_id AND p.mode = r.mode AND p.run = r.run AND p.pos = 0
LEFT JOIN x_irorder t ON t.request_id = r.request_id AND t.pos = 0
""")
cte("x_irpair", """
SELECT r.request_id, r.mode, r.run, coalesce(q.v, 0) AS v FROM x_irruns r LEFT JOIN (
  SELECT a.request_id, a.mode, a.run, avg(CASE WHEN a.rg < b.rg THEN 1.0 ELSE 0.0 END) AS v
  FROM x_irhit a JOIN x_irhit b ON b.request_id = a.request_id AND b.mode = a.mode AND b.run = a.run AND a.pos < b.pos
  WHERE a.rg IS NOT NULL AND b.rg IS NOT NULL GROUP BY ALL) q
ON q.request_id = r.request_id AND q.mode = r.mode AND q.run = r.run
""")
cte("x_irfoot", """
SELECT r.request_id, r.mode, r.run, coalesce(q.v, 0) AS v FROM x_irruns r LEFT JOIN (
  SELECT request_id, mode, run, CASE WHEN count(*) * count(*) // 2 = 0 THEN 1
    ELSE 1 - sum(abs(pos - rg))::DOUBLE / (count(*) * count(*) // 2) END AS v
  FROM x_irhit WHERE rg IS NOT NULL GROUP BY ALL) q
ON q.request_id = r.request_id AND q.mode = r.mode AND q.run = r.run
""")
cte("x_irn5", _ir_ndcg("5", "({}::DOUBLE)"))
cte("x_irn10", _ir_ndcg("10", "({}::DOUBLE)"))
cte("x_irnexp", _ir_ndcg("l.n", "(pow(2, {}) - 1)"))

_IRCELLS = ", ".join(f"coalesce(max(n10) FILTER (WHERE run = {i}), 0) AS ndcg10_{i}" for i in range(1, 6))
cte("x_irwide", f"""
SELECT q.request_id, q.mode, coalesce(avg(n5), 0) AS "avg_ndcg@5", coalesce(avg(n10), 0) AS "avg_ndcg@10",
       coalesce(avg(pa), 0) AS avg_pairacc, coalesce(avg(t1), 0) AS avg_top1, coalesce(avg(fr), 0) AS "avg_spearmanF", {_IRCELLS}
FROM (SELECT request_id, mode FROM x_irtruth, (VALUES ('direct'), ('cot')) m(mode)) q LEFT JOIN (
SELECT request_id, mode, run, a.v AS n5, b.v AS n10, c.v AS pa, d.v AS t1, e.v AS fr FROM x_irn5 a JOIN x_irn10 b USING (request_id, mode, run) JOIN x_irpair c USING (request_id, mode, run)
JOIN x_irtop1 d USING (request_id, mode, run) JOIN x_irfoot e USING (request_id, mode, run)) s
ON s.request_id = q.request_id AND s.mode = q.mode GROUP BY q.request_id, q.mode
""")
_IRCOLS = ["avg_ndcg@5", "avg_ndcg@10", "avg_pairacc", "avg_top1", "avg_spearmanF"] + [f"ndcg10_{i}" for i in range(1, 6)]


def _rounded(cols, wrap="{}") -> str:
    return ", ".join(f"{r6(wrap.format(chr(34) + c + chr(34)))} AS \"{c}\"" for c in cols)


SCORING = {
    "explode_runs": "SELECT request_id, mode, run, text, num_tokens FROM x_runs",
    "outputs_files": "SELECT request_id, mode, run, text, num_tokens FROM x_runs",
    "token_means_npy": f"""SELECT row_number() OVER (PARTITION BY mode ORDER BY request_id) - 1 AS row, mode, {r6('avg_tokens')} AS avg_tokens
        FROM x_tokens""",
    "parse_rec_answers": "SELECT request_id, mode, run, pos, item_id FROM x_ids",
    "avg_tokens": f"SELECT request_id, mode, {r6('avg_tokens')} AS avg_tokens FROM x_tokens",
    "rec_ndcg": f"""SELECT request_id, mode, run, {r6('coalesce(ndcg5, -1)')} AS ndcg5,
        {r6('coalesce(ndcg10, -1)')} AS ndcg10 FROM x_runscore""",
    "rec_recall": f"""SELECT request_id, mode, run, {r6('coalesce(recall5, -1)')} AS recall5,
        {r6('coalesce(recall10, -1)')} AS recall10 FROM x_runscore""",
    "rec_metrics_wide": f"SELECT request_id, mode, {_rounded(_WIDE_COLS)} FROM x_wide",
    "rec_summary": f"""
        SELECT mode, split, {r6('avg("avg_recall@5")')} AS "recall@5", {r6('avg("avg_ndcg@5")')} AS "ndcg@5",
          {r6('avg("avg_recall@10")')} AS "recall@10", {r6('avg("avg_ndcg@10")')} AS "ndcg@10",
          {r6('avg(avg_tokens)')} AS avg_tokens
        FROM x_wide JOIN x_tokens USING (request_id, mode) JOIN x_split USING (request_id) GROUP BY mode, split""",
    "load_metrics": f"""
        SELECT request_id, mode, {r6(_mean('ndcg10'))} AS mean_ndcg,
          {r6('CASE WHEN request_id % 50 = 1 THEN ' + _mean('ndcg10') + ' ELSE "avg_ndcg@10" END')} AS avg_ndcg_at_10,
          {r6(_mean('recall10'))} AS mean_recall, {r6('"avg_recall@10"')} AS avg_recall_at_10 FROM x_wide""",
    "mode_pair": f"""
        SELECT request_id,
          max({r6(_mean('ndcg10'))}) FILTER (WHERE mode = 'direct') AS direct_mean_ndcg,
          max({r6(_mean('recall10'))}) FILTER (WHERE mode = 'direct') AS direct_mean_recall,
          max({r6(_mean('ndcg10'))}) FILTER (WHERE mode = 'cot') AS cot_mean_ndcg,
          max({r6(_mean('recall10'))}) FILTER (WHERE mode = 'cot') AS cot_mean_recall
        FROM x_wide GROUP BY request_id""",
    "mode_label": """SELECT request_id,
        (CASE WHEN c_ndcg > d_ndcg THEN 1 WHEN c_ndcg < d_ndcg THEN 0 ELSE 2 END)::INT AS label FROM x_stable""",
    "oracle_mix": f"""
        SELECT request_id, {r6('greatest(c_ndcg, d_ndcg)')} AS mixed_ndcg,
          {r6('CASE WHEN c_ndcg > d_ndcg THEN c_tok ELSE d_tok END')} AS mixed_tokens,
          (c_ndcg > d_ndcg)::INT AS chosen FROM x_stable""",
    "win_rates": f"""
        SELECT {r6('avg((c_ndcg > d_ndcg)::INT)')} AS cot_rate, {r6('avg((c_ndcg < d_ndcg)::INT)')} AS direct_rate
        FROM x_stable""",
    "parse_ir_answers": "SELECT request_id, mode, run, pos, passage FROM x_irids",
    "ir_top1": f"SELECT request_id, mode, run, {r6('v')} AS top1 FROM x_irtop1",
    "ir_pairacc": f"SELECT request_id, mode, run, {r6('v')} AS pairacc FROM x_irpair",
    "ir_footrule": f"SELECT request_id, mode, run, {r6('v')} AS footrule FROM x_irfoot",
    "ir_ndcg": f"SELECT request_id, mode, run, {r6('v')} AS ndcg FROM x_irn5",
    "ir_ndcg_exp": f"SELECT request_id, mode, run, {r6('v')} AS ndcg FROM x_irnexp",
    "ir_metrics_wide": f"SELECT request_id, mode, {_rounded(_IRCOLS)} FROM x_irwide",
    "ir_summary": f"""
        SELECT mode, {_rounded(_IRCOLS, 'avg({})')}, {r6('avg(coalesce(avg_tokens, 0))')} AS avg_tokens
        FROM x_irwide LEFT JOIN (SELECT request_id, mode, avg(coalesce(num_tokens, 0)) AS avg_tokens FROM x_irruns GROUP BY ALL)
        USING (request_id, mode) GROUP BY mode""",
}
