"""Common table expressions for the derived request, answer and vector tables."""

from routegauge.oracle.builder import cte, h

cte("x_items", "SELECT p_partkey AS item_id, p_name AS title, p_type AS genres FROM part WHERE p_brand <> 'Brand#7'")

cte("x_bought", """
SELECT request_id, item_id, rn, count(*) OVER (PARTITION BY request_id) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, item_id DESC) AS rn
  FROM (
    SELECT o_custkey AS request_id, l_partkey AS item_id, o_orderdate, l_orderkey, l_linenumber,
           row_number() OVER (PARTITION BY o_custkey, l_partkey
                              ORDER BY o_orderdate, l_orderkey, l_linenumber) AS nth
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE nth = 1)
""")

cte("x_truth", "SELECT request_id, 3 - rn AS pos, item_id FROM x_bought WHERE n > 3 AND rn <= 3")
cte("x_history", "SELECT request_id, n - rn AS pos, item_id FROM x_bought WHERE n > 3 AND rn > 3")
cte("x_req", "SELECT DISTINCT request_id FROM x_truth")

cte("x_cands", """
SELECT request_id, item_id,
       row_number() OVER (PARTITION BY request_id ORDER BY md5(request_id || ':' || item_id), item_id) - 1 AS pos
FROM (
  SELECT request_id, item_id FROM x_truth
  UNION
  SELECT request_id, (request_id * 31 + j * 97) % (SELECT count(*) FROM part) AS item_id
  FROM x_req, range(17) AS g(j))
""")

cte("x_reqds", """
SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'ml-1m' WHEN 'BUILDING' THEN 'MovieLens'
  WHEN 'AUTOMOBILE' THEN 'amazon-game' WHEN 'FURNITURE' THEN 'steam' WHEN 'HOUSEHOLD' THEN 'id-only' END AS dataset
FROM customer
""")

_KEY = "r.request_id || ':' || mode || ':' || run"

cte("x_runs", f"""
WITH grid AS (
  SELECT request_id, mode, run FROM x_req, (VALUES ('direct'), ('cot')) m(mode), range(1, 7) g(run)
  WHERE request_id % 40 <> 27 AND run <= CASE request_id % 10 WHEN 9 THEN 3 WHEN 4 THEN 6 ELSE 5 END),
ranked AS (
  SELECT r.request_id, mode, run, c.item_id,
         row_number() OVER (PARTITION BY r.request_id, mode, run ORDER BY
           {h(_KEY + " || ':' || c.item_id")} / 4294967296.0::DOUBLE +
           CASE WHEN t.item_id IS NULL THEN 0.0::DOUBLE WHEN mode = 'direct' THEN 0.2::DOUBLE
                WHEN r.request_id % 3 <> 0 THEN 0.35::DOUBLE ELSE 0.05::DOUBLE END DESC, c.item_id) AS rn
  FROM grid r JOIN x_cands c ON c.request_id = r.request_id
  LEFT JOIN x_truth t ON t.request_id = c.request_id AND t.item_id = c.item_id),
listed AS (
  SELECT r.request_id, mode, run, {h(_KEY)} AS h, string_agg(item_id::VARCHAR, ', ' ORDER BY rn) AS ids,
         min(item_id) FILTER (WHERE rn = 1) AS lead
  FROM ranked r WHERE rn <= 10 GROUP BY ALL),
said AS (SELECT *, CASE WHEN h % 7 = 0 THEN ids || ', ' || lead ELSE ids END AS plain FROM listed)
SELECT request_id, mode, run::INT AS run,
  CASE h % 10
    WHEN 0 THEN 'I cannot decide on a ranking.'
    WHEN 1 THEN 'Sure.' || chr(10) || 'Recommendation result: ' || plain
    WHEN 2 THEN ' ' || plain || chr(10)
    WHEN 3 THEN 'My answer is [' || chr(10) || plain || chr(10) || '] for 3 reasons.'
    WHEN 4 THEN '<OUTPUT> ranking  result : ' || replace(plain, ', ', '，') || ' </OUTPUT>'
    WHEN 5 THEN '<output>Ranking result: [none]</output> ' || plain
    ELSE '<thought>Item [99] came first, then' || chr(10) || '7.</thought>' || chr(10) ||
         '<output>Recommendation result: [' || plain || ']</output>' END AS text,
  (CASE WHEN h % 50 = 0 THEN NULL WHEN mode = 'direct' THEN 20 + h % 30 WHEN request_id % 20 = 0 THEN 15
        ELSE 250 + h % 900 END)::INT AS num_tokens
FROM said
""")

cte("x_emb", "SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings")
cte("x_nemb", "SELECT count(*) AS n FROM embeddings")

cte("x_entries", """
SELECT e.request_id, e.section, e.pos, e.item_id, v.v, v.nrm,
       row_number() OVER (PARTITION BY e.request_id, e.section ORDER BY e.pos) - 1 AS dpos
FROM (SELECT request_id, 'history' AS section, pos, item_id FROM x_history WHERE request_id % 97 <> 3
      UNION ALL SELECT request_id, 'candidate', pos, item_id FROM x_cands) e
JOIN x_emb v ON v.vec_id = e.item_id % (SELECT n FROM x_nemb)
WHERE e.item_id % 101 <> 5
""")

cte("x_irwant", """
SELECT vec_id AS request_id, j AS pos, substr('ABCDEFGHIJ', j::INT + 1, 1) AS id,
       (vec_id * 7 + j * 13 + 1) % (SELECT n FROM x_nemb) AS cand_vec
FROM embeddings, range(10) g(j)
""")

cte("x_irentries", """
SELECT w.request_id, 'candidate' AS section, w.pos, v.v, v.nrm,
       row_number() OVER (PARTITION BY w.request_id ORDER BY w.pos) - 1 AS dpos
FROM x_irwant w JOIN x_emb v ON v.vec_id = w.cand_vec WHERE (w.request_id + w.pos) % 37 <> 4
UNION ALL
SELECT vec_id, 'query', 0, v, nrm, 0 FROM x_emb WHERE vec_id % 61 <> 9
""")

cte("x_sims", """
SELECT w.request_id, w.id,
       round(list_dot_product(q.v, c.v) / (q.nrm + 1e-12::DOUBLE) / (c.nrm + 1e-12::DOUBLE), 9) AS cos
FROM x_irwant w JOIN x_emb q ON q.vec_id = w.request_id JOIN x_emb c ON c.vec_id = w.cand_vec
""")

cte("x_irtruth", """
SELECT request_id, string_agg('[' || id || ']', ' > ' ORDER BY cos DESC, id) ||
  CASE WHEN request_id % 40 = 0 THEN ' > [' || arg_max(id, (cos, -ascii(id))) || ']' ELSE '' END AS ground_truth
FROM x_sims GROUP BY request_id
""")

cte("x_irruns", f"""
WITH grid AS (
  SELECT DISTINCT request_id, mode, run FROM x_sims, (VALUES ('direct'), ('cot')) m(mode), range(1, 6) g(run)
  WHERE request_id % 40 <> 27 AND run <= CASE WHEN request_id % 3 = 0 THEN 5 ELSE 4 END),
ranked AS (
  SELECT r.request_id, mode, run, s.id, {h(_KEY)} AS h,
         row_number() OVER (PARTITION BY r.request_id, mode, run ORDER BY
           round(s.cos + CASE WHEN mode = 'direct' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END *
                 ({h(_KEY + " || ':' || s.id")} / 4294967296.0::DOUBLE), 9) DESC, s.id) AS rn
  FROM grid r JOIN x_sims s ON s.request_id = r.request_id),
joined AS (
  SELECT request_id, mode, run, h,
         string_agg('[' || id || ']', ' > ' ORDER BY rn) FILTER (WHERE h % 11 <> 0 OR rn = 1) AS ids,
         min(id) FILTER (WHERE rn = 2) AS second
  FROM ranked GROUP BY request_id, mode, run, h),
listed AS (
  SELECT request_id, mode, run, h,
         ids || CASE h % 11 WHEN 2 THEN ' > [Z]' WHEN 3 THEN ' > [' || second || ']' ELSE '' END AS ids
  FROM joined)
SELECT request_id, mode, run::INT AS run,
  CASE WHEN h % 11 = 1 THEN 'No passage is relevant.'
       WHEN h % 3 = 0 THEN 'Ranking:' || chr(10) || ids
       WHEN h % 3 = 1 THEN '<OUTPUT>' || chr(10) || lower(ids) || chr(10) || '</OUTPUT>'
       ELSE '<thought>[J] looks weak</thought> <output>' || ids || '</output> [X]' END AS text,
  (CASE WHEN h % 50 = 0 THEN NULL WHEN mode = 'direct' THEN 20 + h % 30 WHEN request_id % 20 = 0 THEN 15
        ELSE 250 + h % 900 END)::INT AS num_tokens
FROM listed
""")

cte("x_irrec", """
SELECT g.request_id,
  'I will provide you with ' || (g.n + CASE WHEN g.request_id % 25 = 0 THEN 1 ELSE 0 END) ||
    ' passages, each with an id in square brackets' AS task_desc,
  'Search Query: ' || replace(b.text, chr(10), ' ') AS search_query_line, options_text
FROM (
  SELECT doc_id // 10 AS request_id, count(*) AS n,
    string_agg('[' || substr('ABCDEFGHIJ', (doc_id % 10)::INT + 1, 1) || '] ' ||
      CASE WHEN (doc_id // 10) % 30 = 0 AND doc_id % 10 = 2 THEN '' ELSE text END, chr(10) ORDER BY doc_id) AS options_text
  FROM documents GROUP BY 1) g
JOIN benchmark b ON b.item_id = g.request_id % (SELECT count(*) FROM benchmark)
""")

cte("x_split", f"SELECT request_id, CASE WHEN {h("request_id || ':split'")} % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM x_req")
