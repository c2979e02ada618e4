"""Checks for labels, splits, policies and reports."""

from routegauge.oracle.builder import cte, h, r6

_RUNS = ", ".join(f"CASE WHEN ndcg10_{i} = -1 THEN 0 ELSE ndcg10_{i} END" for i in range(1, 6))
cte("x_five", f"""
SELECT request_id, mode, unnest([{_RUNS}]::DOUBLE[]) AS v FROM x_wide
""")
cte("x_stats", """
SELECT f.request_id, f.mode, round(avg(v), 9) AS mu, round(var_pop(v), 9) AS va, any_value(round(t.avg_tokens, 9)) AS tok
FROM x_five f JOIN x_tokens t ON t.request_id = f.request_id AND t.mode = f.mode GROUP BY f.request_id, f.mode
""")
cte("x_gap", """
SELECT d.request_id, d.mu AS mu_d, c.mu AS mu_c, d.va AS var_d, c.va AS var_c, d.tok AS tok_d, c.tok AS tok_c,
  (c.mu - 0.1::DOUBLE * (c.tok / 1000.0::DOUBLE)) - (d.mu - 0.1::DOUBLE * (d.tok / 1000.0::DOUBLE)) AS gap
FROM x_stats d JOIN x_stats c ON c.request_id = d.request_id AND d.mode = 'direct' AND c.mode = 'cot'
""")
cte("x_shuffled", """
SELECT request_id, split, row_number() OVER (PARTITION BY split ORDER BY md5(request_id || ':2025'), request_id) AS rn,
       count(*) OVER (PARTITION BY split) AS n FROM x_split
""")
cte("x_dev", """
SELECT request_id, CASE WHEN split = 'train' AND rn > round_even(n * 0.75::DOUBLE, 0) THEN 'dev' ELSE split END AS split
FROM x_shuffled
""")
cte("x_core", f"""
SELECT g.*, s.split, CASE WHEN abs(gap) < 0.003::DOUBLE THEN 0.0::DOUBLE ELSE round(gap, 9) END AS adv,
  exp(-5.0::DOUBLE * (var_d + var_c)) AS weight,
  round(CASE WHEN abs(gap) < 0.003::DOUBLE THEN 0.0::DOUBLE ELSE round(gap, 9) END
    + 0.3::DOUBLE * ({h("g.request_id || ':score'")} / 4294967296.0::DOUBLE - 0.5::DOUBLE), 3) + 0.0::DOUBLE AS score
FROM x_gap g JOIN x_dev s ON s.request_id = g.request_id
""")
cte("x_ranked", """
SELECT *, row_number() OVER (ORDER BY score DESC, request_id) AS rn, count(*) OVER () AS n FROM x_core
""")


def report(pred: str, lam: str = "0.1::DOUBLE") -> str:
    nd = f"CASE WHEN {pred} = 1 THEN mu_c ELSE mu_d END"
    tk = f"CASE WHEN {pred} = 1 THEN tok_c ELSE tok_d END"
    return f"""{r6(f'avg({nd})')} AS mean_ndcg, {r6(f'avg({tk})')} AS mean_tokens, {r6(f'sum({tk})')} AS total_tokens,
      {r6(f'avg({nd}) - {lam} * avg({tk}) / 1000')} AS utility, {r6(f'avg({pred})')} AS cot_rate"""


def quantile(table: str, value: str, q: str) -> str:
    """Linear interpolation written out; the table needs no prior order."""
    return f"""(SELECT CASE WHEN f < 0.5 THEN a + (b - a) * f ELSE b - (b - a) * (1 - f) END FROM (
      SELECT vi - floor(vi) AS f, l[floor(vi)::BIGINT + 1] AS a, l[least(floor(vi)::BIGINT + 2, c)] AS b FROM (
        SELECT list_sort(list({value})) AS l, (count(*) - 1) * ({q}) AS vi, count(*) AS c FROM {table})))"""


def curve(table: str, pos: str, neg: str, lo: str = "0.0::DOUBLE", step: str = "0.01::DOUBLE", count: str = "101") -> str:
    """Every grid point against every ranked row, without prefix sums."""
    return f"""
    SELECT g.i AS point, {lo} + g.i * {step} AS rate, round_even(({lo} + g.i * {step}) * any_value(n), 0)::BIGINT AS k,
      round(avg(CASE WHEN rn <= round_even(({lo} + g.i * {step}) * n, 0) THEN mu_{pos} ELSE mu_{neg} END), 12) AS mean_ndcg,
      round(avg(CASE WHEN rn <= round_even(({lo} + g.i * {step}) * n, 0) THEN tok_{pos} ELSE tok_{neg} END), 12) AS mean_tokens,
      sum(CASE WHEN rn <= round_even(({lo} + g.i * {step}) * n, 0) THEN tok_{pos} ELSE tok_{neg} END) AS total_tokens,
      avg(CASE WHEN rn <= round_even(({lo} + g.i * {step}) * n, 0) THEN 1 ELSE 0 END) AS cot_rate
    FROM {table}, range({count}) g(i) GROUP BY g.i"""


_CURVE_COLS = f"""point, {r6('rate')} AS rate, k, {r6('mean_ndcg')} AS mean_ndcg, {r6('mean_tokens')} AS mean_tokens,
  {r6('total_tokens')} AS total_tokens, {r6('mean_ndcg - 0.1 * mean_tokens / 1000')} AS utility, {r6('cot_rate')} AS cot_rate"""

cte("x_sweep", curve("x_ranked", "c", "d"))
cte("x_sweepbest", "SELECT * FROM x_sweep ORDER BY mean_ndcg DESC, point LIMIT 1")
cte("x_finegrid", """
SELECT greatest(0.0::DOUBLE, rate - 0.05::DOUBLE) AS lo,
  ceil((least(1.0::DOUBLE, rate + 0.05::DOUBLE) + 1e-12::DOUBLE - greatest(0.0::DOUBLE, rate - 0.05::DOUBLE)) / 0.002::DOUBLE)::BIGINT AS cnt
FROM x_sweepbest
""")
cte("x_fine", curve("x_ranked", "c", "d", "(SELECT lo FROM x_finegrid)", "0.002::DOUBLE", "200")
    + " HAVING g.i < (SELECT cnt FROM x_finegrid)")

# --- signed ranks and the front ---------------------------------------------------------------------

cte("x_mode", """
SELECT round(avg(mu_c), 12) >= round(avg(mu_d), 12) AS cot, greatest(avg(mu_c), avg(mu_d)) AS best FROM x_core WHERE split = 'dev'
""")
cte("x_signed", """
SELECT c.* EXCLUDE (score), CASE WHEN cot THEN score ELSE -score END AS signed, cot,
  CASE WHEN cot THEN mu_c ELSE mu_d END AS mu_p, CASE WHEN cot THEN mu_d ELSE mu_c END AS mu_n,
  CASE WHEN cot THEN tok_c ELSE tok_d END AS tok_p, CASE WHEN cot THEN tok_d ELSE tok_c END AS tok_n,
  row_number() OVER (PARTITION BY split ORDER BY CASE WHEN cot THEN score ELSE -score END DESC, request_id) AS rn,
  count(*) OVER (PARTITION BY split) AS n
FROM x_core c, x_mode
""")
cte("x_devrank", "SELECT * FROM x_signed WHERE split = 'dev'")
cte("x_curve", curve("x_devrank", "p", "n"))
cte("x_front", """
SELECT *, row_number() OVER (ORDER BY mean_tokens, point) - 1 AS idx FROM (
  SELECT *, coalesce(max(mean_ndcg) OVER (ORDER BY mean_tokens, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen
  FROM x_curve) WHERE mean_ndcg > seen + 1e-12::DOUBLE
""")
cte("x_normed", """
SELECT *, 1 - (mean_tokens - min(mean_tokens) OVER ()) / greatest(max(mean_tokens) OVER () - min(mean_tokens) OVER (), 1e-12::DOUBLE) AS x,
  (mean_ndcg - min(mean_ndcg) OVER ()) / greatest(max(mean_ndcg) OVER () - min(mean_ndcg) OVER (), 1e-12::DOUBLE) AS y FROM x_front
""")
cte("x_knee", "SELECT * FROM x_normed ORDER BY round(abs(y - x) / sqrt(2), 12) DESC, idx LIMIT 1")
cte("x_utopia", "SELECT * FROM x_normed ORDER BY round(sqrt((1 - x) * (1 - x) + (1 - y) * (1 - y)), 12), idx LIMIT 1")
cte("x_eps", """
SELECT * FROM x_normed WHERE mean_ndcg >= round((SELECT best FROM x_mode), 12) - 1e-12::DOUBLE ORDER BY mean_tokens, idx LIMIT 1
""")
cte("x_eps6", """
SELECT * FROM x_normed WHERE mean_ndcg >= round((SELECT best FROM x_mode), 6) - 1e-12::DOUBLE ORDER BY mean_tokens, idx LIMIT 1
""")
cte("x_bestr", "SELECT * FROM x_curve ORDER BY mean_ndcg DESC, point LIMIT 1")
cte("x_tau", f"SELECT {quantile('x_devrank', 'signed', '1.0::DOUBLE - (SELECT rate FROM x_bestr)')} AS tau")
cte("x_preds", """
SELECT s.*, CASE WHEN cot = (signed >= (SELECT tau FROM x_tau)) THEN 1 ELSE 0 END AS pred_topr,
  CASE WHEN cot = (rn <= round_even((SELECT rate FROM x_knee) * n, 0)) THEN 1 ELSE 0 END AS pred_knee,
  CASE WHEN cot = (rn <= round_even((SELECT rate FROM x_utopia) * n, 0)) THEN 1 ELSE 0 END AS pred_utopia,
  CASE WHEN (SELECT count(*) FROM x_eps) = 0 THEN NULL
       WHEN cot = (rn <= round_even((SELECT rate FROM x_eps) * n, 0)) THEN 1 ELSE 0 END AS pred_eps
FROM x_signed s WHERE split IN ('dev', 'test')
""")
cte("x_reports", " UNION ALL ".join(
    f"SELECT '{name}' AS policy, split, {report(col)} FROM x_preds WHERE {col} IS NOT NULL GROUP BY split"
    for name, col in (("Top-r", "pred_topr"), ("Knee", "pred_knee"), ("Utopia", "pred_utopia"), ("Epsilon", "pred_eps"))
))
cte("x_bases", " UNION ALL ".join(
    f"SELECT '{name}' AS policy, split, {report(pred)} FROM x_core GROUP BY split"
    for name, pred in (("Always-Direct", "0"), ("Always-CoT", "1"))
))

# --- budgets ----------------------------------------------------------------------------------------


def _targets(table: str) -> str:
    return f"""SELECT i, round(d + (c - d) * i / 10, 9) AS target FROM (
      SELECT round(avg(tok_d), 6) AS d, round(avg(tok_c), 6) AS c FROM {table}), range(11) g(i)"""


cte("x_targets", _targets("x_core"))
cte("x_devcore", "SELECT * FROM x_core WHERE split = 'dev'")
cte("x_devtargets", _targets("x_devcore"))
cte("x_paid", """
SELECT list(struct_pack(cost := tok_c - tok_d, ndcg := mu_c - mu_d, cnt := 1.0::DOUBLE)
            ORDER BY score / (tok_c - tok_d) DESC, request_id) AS items
FROM x_core WHERE tok_c - tok_d > 0 AND score > 0
""")
cte("x_unpaid", """
SELECT count(*) AS n, sum(tok_d) AS base, sum(mu_d) AS ndcg,
  coalesce(sum(tok_c - tok_d) FILTER (WHERE tok_c <= tok_d AND score > 0), 0) AS f_tok,
  coalesce(sum(mu_c - mu_d) FILTER (WHERE tok_c <= tok_d AND score > 0), 0) AS f_ndcg,
  count(*) FILTER (WHERE tok_c <= tok_d AND score > 0) AS f_cnt FROM x_core
""")
cte("x_greedy", """
SELECT i, target, n, list_reduce(items, lambda acc, it: CASE WHEN acc.cost + it.cost <= target * n + 1e-9::DOUBLE
    THEN struct_pack(cost := acc.cost + it.cost, ndcg := acc.ndcg + it.ndcg, cnt := acc.cnt + 1.0::DOUBLE) ELSE acc END,
  struct_pack(cost := base + f_tok, ndcg := ndcg + f_ndcg, cnt := f_cnt::DOUBLE)) AS r
FROM x_targets, x_paid, x_unpaid
""")
_GREEDY = f"""SELECT {r6('target')} AS budget_mean_tokens, r.cnt::BIGINT AS selected, {r6('r.ndcg / n')} AS mean_ndcg,
  {r6('r.cost / n')} AS mean_tokens, {r6('r.cost')} AS total_tokens, {r6('r.ndcg / n - 0.1 * r.cost / n / 1000')} AS utility,
  {r6('r.cnt / n')} AS cot_rate, r.cost / n <= target + 1e-9::DOUBLE AS feasible FROM x_greedy"""


def _eta(table: str, target: str) -> str:
    return f"""(SELECT coalesce(min(density) FILTER (WHERE used <= ({target}) * n + 1e-9::DOUBLE - base), 'inf'::DOUBLE) FROM (
      SELECT density, sum(need) OVER (ORDER BY density DESC, request_id ROWS UNBOUNDED PRECEDING) AS used,
             count(*) OVER () AS n, sum(tok_d) OVER () AS base
      FROM (SELECT request_id, tok_d, CASE WHEN tok_c > tok_d THEN score / (tok_c - tok_d) ELSE 'inf'::DOUBLE END AS density,
                   greatest(tok_c - tok_d, 0) AS need FROM {table})))"""


cte("x_testcore", "SELECT * FROM x_core WHERE split = 'test'")
cte("x_neweta", f"""
SELECT target, {_eta('x_testcore', '(SELECT target FROM x_devtargets WHERE i = 5)')} AS eta FROM x_devtargets WHERE i = 5
""")
_DENSE = """CASE WHEN (tok_c <= tok_d AND score > 0) OR score / greatest(tok_c - tok_d, 1e-12::DOUBLE) >= {} THEN 1 ELSE 0 END"""
cte("x_rebuilt", f"SELECT t.*, {_DENSE.format('(SELECT eta FROM x_neweta)')} AS pred FROM x_testcore t")

_POINT = f"idx, {r6('rate')} AS rate, {r6('mean_ndcg')} AS mean_ndcg, {r6('mean_tokens')} AS mean_tokens"

cte("x_train", "SELECT * FROM x_core WHERE split = 'train'")
cte("x_positive", "SELECT adv FROM x_train WHERE adv > 0.003::DOUBLE")
cte("x_cuts", "SELECT DISTINCT t FROM (" + " UNION ALL ".join(
    f"SELECT {quantile('x_positive', 'adv', q + '::DOUBLE')} AS t" for q in ("0.5", "0.8", "0.95")
) + ") WHERE (SELECT count(*) FROM x_positive) >= 50")

_METRICS = ["avg_recall@5", "avg_ndcg@5", "avg_recall@10", "avg_ndcg@10"]


def _policy_metrics(name: str, col: str) -> str:
    cells = ", ".join(f"{r6(f'avg(w.{chr(34)}{m}{chr(34)})')} AS \"{m}\"" for m in _METRICS)
    return f"""SELECT '{name}' AS policy, {cells}, {r6('avg(t.avg_tokens)')} AS avg_tokens
      FROM x_preds p JOIN x_wide w ON w.request_id = p.request_id AND (w.mode = 'cot') = ({col} = 1)
      JOIN x_tokens t ON t.request_id = w.request_id AND t.mode = w.mode WHERE p.split = 'test'"""


_LONG = ["mean_ndcg", "mean_tokens", "total_tokens", "utility", "cot_rate"]

ROUTING = {
    "trimmed_stats": f"""SELECT request_id, mode, {r6('avg(v)')} AS mean_trim10,
        {r6('(sum(v) - min(v) - max(v)) / 3')} AS mean_trim25, {r6('var_pop(v)')} AS variance
        FROM x_five GROUP BY request_id, mode""",
    "split_dev": "SELECT request_id, split FROM x_dev",
    "advantage": f"""SELECT request_id, CASE WHEN split = 'dev' THEN 'train' ELSE split END AS split,
        {r6('adv')} AS advantage, {r6('weight')} AS weight FROM x_core""",
    "rank_thresholds": f"""
        SELECT 0::INT AS grade, 0.0::DOUBLE AS gain, NULL::DOUBLE AS threshold
        UNION ALL SELECT 1, 1.0, NULL
        UNION ALL SELECT (1 + row_number() OVER (ORDER BY t))::INT, pow(2, row_number() OVER (ORDER BY t)), {r6('t')} FROM x_cuts""",
    "rank_labels": """SELECT request_id, split, (CASE WHEN adv <= 0.003::DOUBLE THEN 0
        ELSE 1 + (SELECT count(*) FROM x_cuts WHERE c.adv > t) END)::INT AS grade FROM x_core c""",
    "eval_policy": f"SELECT split, {report('(score > 0)::INT')} FROM x_core GROUP BY split",
    "baselines": "SELECT * FROM x_bases",
    "tau_top_r": " UNION ALL ".join(
        f"SELECT {r}::DOUBLE AS rate, {r6(quantile('x_core', 'score', f'1.0::DOUBLE - {r}::DOUBLE'))} AS tau"
        for r in ("0.0", "0.13", "0.25", "0.5", "1.0")
    ),
    "apply_policy": f"""SELECT request_id, (score >= 0.05::DOUBLE)::INT AS pred_tau,
        ({_DENSE.format('0.0002::DOUBLE')})::INT AS pred_density FROM x_core""",
    "top_r": """SELECT request_id, rn, (rn <= 0)::INT AS pred_0, (rn <= round_even(0.25::DOUBLE * n, 0))::INT AS pred_25,
        (rn <= round_even(0.5::DOUBLE * n, 0))::INT AS pred_50 FROM x_ranked""",
    "rate_sweep": f"SELECT {_CURVE_COLS} FROM x_sweep",
    "refine_rate": f"SELECT {_CURVE_COLS} FROM (SELECT * FROM x_fine ORDER BY mean_ndcg DESC, point LIMIT 1)",
    "min_rate_target": f"""SELECT {_CURVE_COLS} FROM (SELECT * FROM x_sweep WHERE mean_ndcg >=
        (SELECT round(greatest(avg(mu_c), avg(mu_d)), 6) FROM x_core) - 1e-12::DOUBLE ORDER BY point LIMIT 1)""",
    "greedy_budget": _GREEDY + " WHERE i = 5",
    "budget_curve": _GREEDY,
    "eta_budget": " UNION ALL ".join(
        f"SELECT target, round({_eta('x_core', f'SELECT target FROM x_targets WHERE i = {i}')}, 9) AS eta FROM x_targets WHERE i = {i}"
        for i in (1, 5, 9)
    ),
    "rebuild_budget": f"""SELECT {report('pred').replace(', 6)', ', 9)')}, round((SELECT eta FROM x_neweta), 9) AS eta,
        (SELECT target FROM x_neweta) AS target FROM x_rebuilt""",
    "pareto": f"SELECT idx::INT AS idx, {_POINT[5:]} FROM x_front",
    "knee": f"SELECT 'knee' AS selector, idx::INT AS idx, {_POINT[5:]} FROM x_knee",
    "utopia": f"SELECT 'utopia' AS selector, idx::INT AS idx, {_POINT[5:]} FROM x_utopia",
    "epsilon": f"SELECT 'epsilon' AS selector, idx::INT AS idx, {_POINT[5:]} FROM x_eps6",
    "apply_symmetric": """SELECT request_id, split, pred_topr::INT AS pred_topr, pred_utopia::INT AS pred_utopia FROM x_preds""",
    "policy_report": "SELECT * FROM x_reports",
    "policy_metrics": " UNION ALL ".join(
        _policy_metrics(n, c) for n, c in (("pred_topr", "p.pred_topr"), ("pred_utopia", "p.pred_utopia"), ("pred_none", "0"))
    ),
    "policy_summary": " UNION ALL ".join(
        [f"SELECT split || ' baselines' AS section, policy, '{m}' AS metric, {m} AS value FROM x_bases WHERE split <> 'train'" for m in _LONG]
        + [f"SELECT split || ' reports', policy, '{m}', {m} FROM x_reports" for m in _LONG]
        + [f"SELECT 'params', 'Top-r', 'r', {r6('rate')} FROM x_bestr", f"SELECT 'params', 'Top-r', 'tau', {r6('tau')} FROM x_tau"]
        + [f"SELECT 'params', '{n}', '{m}', {r6(c)} FROM {t}"
           for n, t in (("Knee", "x_knee"), ("Utopia", "x_utopia"), ("Epsilon", "x_eps"))
           for m, c in (("rate", "rate"), ("target_mean_tokens", "mean_tokens"))]
    ),
}
