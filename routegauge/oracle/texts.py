"""Checks for prompts, chats, sections, passages and entries."""

from routegauge import fixed_values as fv
from routegauge.oracle.builder import cte, h, r6, re2


def q(text: str) -> str:
    """SQL literal; line ends are spelled out."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


_MODE = "CASE request_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'CoT' ELSE 'agent' END"

cte("x_lines", f"""
SELECT l.request_id, section, pos::INT AS pos, l.item_id, '§ID:' || l.item_id || CASE
    WHEN dataset IN ('ml-1m', 'MovieLens') THEN ' Title:' || coalesce(title, '{fv.UNKNOWN_TITLE}') || '; Genres:' || coalesce(genres, '{fv.UNKNOWN_GENRES}')
    WHEN dataset IN ('amazon-game', 'steam') THEN ' Title:' || coalesce(title, '{fv.UNKNOWN_TITLE}') ELSE '' END AS line
FROM (SELECT request_id, 'history' AS section, pos, item_id FROM x_history
      UNION ALL SELECT request_id, 'candidate', pos, item_id FROM x_cands) l
JOIN x_reqds d ON d.request_id = l.request_id LEFT JOIN x_items i ON i.item_id = l.item_id
""")
cte("x_prompt", f"""
SELECT r.request_id, dataset, {q(fv.HISTORY_HEADER)} || chr(10) ||
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE section = 'history'), '') || chr(10) || {q(fv.CANDIDATE_HEADER)} || chr(10) ||
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE section = 'candidate'), '') || chr(10) AS prompt
FROM x_req r JOIN x_reqds d ON d.request_id = r.request_id LEFT JOIN x_lines l ON l.request_id = r.request_id GROUP BY r.request_id, dataset
""")
cte("x_system", f"""
SELECT request_id, {_MODE} AS mode, CASE
  WHEN dataset IN ('ml-1m', 'amazon-game') AND request_id % 3 = 0 THEN 'Answer at once.'
  WHEN dataset IN ('ml-1m', 'amazon-game') AND request_id % 3 = 1 THEN 'Think first, then answer.'
  WHEN dataset IN ('ml-1m', 'MovieLens') THEN {q(fv.MOVIE_SYSTEM)}
  WHEN dataset IN ('amazon-game', 'steam') THEN {q(fv.GAME_SYSTEM)} ELSE {q(fv.RANK_SYSTEM)} END AS system
FROM x_reqds
""")

_layout = fv.IR_AGENT_LAYOUT
_pre, _rest = _layout.split("{task}")
_mid, _rest = _rest.split("{query}")
_mid2, _post = _rest.split("{candidates_block}")
cte("x_irprompt", f"""
SELECT request_id, task_desc || {q(_mid)} || search_query_line || {q(_mid2)} || options_text || {q(_post)} AS prompt FROM x_irrec
""")


def lines_of(name: str, prompts: str) -> None:
    cte(name, f"""
    SELECT request_id, no, line, c_end - len(line) AS c_start, c_end, size FROM (
      SELECT request_id, no, line, size,
        sum(len(line) + 1) OVER (PARTITION BY request_id ORDER BY no ROWS UNBOUNDED PRECEDING) - 1 AS c_end FROM (
        SELECT request_id, len(prompt) AS size, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no
        FROM (SELECT request_id, prompt, string_split(prompt, chr(10)) AS l FROM {prompts})))
    """)


def tokens_of(name: str, prompts: str) -> None:
    cte(name, f"""
    SELECT request_id, tok, c_start, c_end, v.v FROM (
      SELECT request_id, n AS tok, CASE WHEN h % 53 = 0 THEN 0 ELSE e - len(piece) END AS c_start,
        CASE WHEN h % 53 = 0 THEN 0 ELSE e END AS c_end, h % (SELECT n FROM x_nemb) AS vec FROM (
        SELECT request_id, n, piece, {h('piece')} AS h,
          sum(len(piece)) OVER (PARTITION BY request_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM (
          SELECT request_id, unnest(p) AS piece, generate_subscripts(p, 1) AS n
          FROM (SELECT request_id, regexp_extract_all(prompt, '\\S+|\\s+') AS p FROM {prompts})))
      WHERE regexp_matches(piece, '\\S')
      UNION ALL SELECT request_id, 0, 0, 0, 0 FROM {prompts})
    JOIN x_emb v ON v.vec_id = vec
    """)


lines_of("x_pline", "x_prompt")
lines_of("x_iline", "x_irprompt")
tokens_of("x_ptok", "x_prompt")
tokens_of("x_itok", "x_irprompt")

cte("x_headers", """
SELECT request_id, any_value(size) AS size, min(c_end) FILTER (WHERE line = 'User''s watched history:') AS h_end,
  min(c_start) FILTER (WHERE line = 'Candidate items:') AS c_start, min(c_end) FILTER (WHERE line = 'Candidate items:') AS c_end
FROM x_pline GROUP BY request_id
""")
cte("x_blocks", r"""
SELECT l.request_id, no, regexp_extract(line, '^§ID:(\d+)', 1)::BIGINT AS item_id, c_start, c_end
FROM x_pline l JOIN x_reqds d ON d.request_id = l.request_id
WHERE CASE WHEN dataset IN ('ml-1m', 'MovieLens') THEN regexp_full_match(line, '§ID:\d+ Title:.+')
  WHEN dataset IN ('amazon-game', 'steam') THEN regexp_full_match(line, '§ID:\d+ Title:.+') ELSE regexp_full_match(line, '§ID:\d+') END
""")
cte("x_spans", """
SELECT b.request_id, b.no, b.item_id, b.c_start, min(t.tok) AS ts, max(t.tok) AS te
FROM x_blocks b JOIN x_ptok t ON t.request_id = b.request_id AND t.c_end > b.c_start AND t.c_start < b.c_end AND t.c_end > 0
GROUP BY ALL
""")
cte("x_aligned", """
SELECT s.*, CASE WHEN s.c_start >= h.h_end AND s.c_start < h.c_start THEN 'history'
  WHEN s.c_start >= h.c_end AND s.c_start < h.size THEN 'candidate' END AS section
FROM x_spans s JOIN x_headers h ON h.request_id = s.request_id
""")


def pooled(name: str, spans: str, tokens: str) -> None:
    cte(name, f"""
    SELECT request_id, no, list(m ORDER BY dim) AS v FROM (
      SELECT request_id, no, dim, avg(val) AS m FROM (
        SELECT s.request_id, s.no, unnest(t.v) AS val, generate_subscripts(t.v, 1) AS dim
        FROM {spans} s JOIN {tokens} t ON t.request_id = s.request_id AND t.tok BETWEEN s.ts AND s.te)
      GROUP BY request_id, no, dim) GROUP BY request_id, no
    """)


pooled("x_ppool", "x_spans", "x_ptok")

# --- retrieval --------------------------------------------------------------------------------------

_START = re2(fv.PASSAGE_START_LINE)
_LABEL = re2(fv.PASSAGE_START_LINE.removesuffix("(?!>)"))
cte("x_iblock", rf"""
SELECT request_id, no, line, c_start, c_end FROM (
  SELECT *, min(no) FILTER (WHERE stop AND no > head) OVER (PARTITION BY request_id) AS fin FROM (
    SELECT *, regexp_matches(line, '{re2(fv.PASSAGES_END_LINE)}') AS stop,
      min(no) FILTER (WHERE regexp_matches(line, '{re2(fv.PASSAGES_HEADER_LINE)}')) OVER (PARTITION BY request_id) AS head
    FROM x_iline))
WHERE no > head AND (fin IS NULL OR no < fin)
""")
cte("x_ipiece", rf"""
SELECT request_id, k, upper(regexp_extract(arg_min(line, no), '{_LABEL}', 1)) AS id,
  regexp_replace(string_agg(line, chr(10) ORDER BY no), '^\s+|\s+$', '', 'g') AS whole,
  min(c_start) AS w_start,
  max(c_start + len(regexp_replace(line, '\s+$', ''))) FILTER (WHERE regexp_matches(line, '\S')) AS w_end
FROM (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '{_START}'))
        OVER (PARTITION BY request_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS k FROM x_iblock)
WHERE k > 0 GROUP BY request_id, k
""")
# Empty passages are two apart at most in these prompts, so one look back decides.
cte("x_ipass", rf"""
SELECT request_id, k AS no, id,
  CASE WHEN bare THEN coalesce(lead(whole) OVER w, '') ELSE regexp_replace(whole, '{_LABEL}\s*', '') END AS text,
  CASE WHEN bare THEN lead(w_start) OVER w ELSE w_start + len(whole) - len(regexp_replace(whole, '{_LABEL}\s*', '')) END AS c_start,
  CASE WHEN bare THEN lead(w_end) OVER w ELSE w_end END AS c_end,
  coalesce(lag(bare) OVER w, false) AS swallowed
FROM (SELECT *, regexp_full_match(whole, '{_LABEL}') AS bare FROM x_ipiece)
WINDOW w AS (PARTITION BY request_id ORDER BY k)
""")
cte("x_ikept", """
SELECT request_id, no, id, text, c_start, c_end FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY no) AS nth FROM x_ipass WHERE NOT swallowed AND text <> '')
WHERE nth = 1
""")
cte("x_iquery", f"""
SELECT request_id, regexp_extract(prompt, '{re2(fv.QUERY_TEXT)}', 1) AS query,
  strpos(prompt, 'Search Query: ') + 13 AS c_start FROM x_irprompt
""")
cte("x_ispans", """
SELECT s.request_id, s.no, min(t.tok) AS ts, max(t.tok) AS te FROM (
  SELECT request_id, no, c_start, c_end FROM x_ikept
  UNION ALL SELECT request_id, 0, c_start, c_start + len(query) FROM x_iquery) s
JOIN x_itok t ON t.request_id = s.request_id AND t.c_end > s.c_start AND t.c_start < s.c_end AND t.c_end > 0 GROUP BY ALL
""")
pooled("x_ipool", "x_ispans", "x_itok")


def summary(v: str) -> str:
    return f"""len({v})::INT AS dims, {r6(f'{v}[1]')} AS "first", {r6(f'{v}[-1]')} AS "last",
      {r6(f'list_sum({v})')} AS total, {r6(f'list_dot_product({v}, {v})')} AS norm2"""


_DOMAINS = {0: "movie", 1: "game", 2: "ir", 3: "ir"}


def _block(domain: str) -> str:
    rows = list(fv.CHECKLIST_INTRO)
    for i, pair in enumerate(fv.CHECKLIST[domain], 1):
        for label, text in zip(("Direct", "CoT"), pair):
            rows.append(f"Q{i} ({label}-friendly): {text}  Answer:")
    return q("\n".join(rows + [fv.CHECKLIST_OUTRO]))


_BLOCK = "CASE request_id % 4 " + " ".join(f"WHEN {k} THEN {_block(d)}" for k, d in _DOMAINS.items()) + " END"
_QUESTIONS = ", ".join(
    f"({k}, {i}::INT, '{side}', {q(text)})"
    for k, d in _DOMAINS.items() for i, pair in enumerate(fv.CHECKLIST[d], 1) for side, text in zip(("dir", "cot"), pair)
)
cte("x_chat", """
SELECT conv_id AS request_id, (turn + CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN 0 ELSE 1 END)::INT AS turn,
  role, text AS content FROM conversations
UNION ALL SELECT conv_id, 0::INT, 'system', 'Answer at once.' FROM conversations
GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0
""")

cte("x_loaded", """
SELECT s.request_id, any_value(s.split) AS split, count(h.item_id)::INT AS n_history
FROM x_split s LEFT JOIN x_history h ON h.request_id = s.request_id GROUP BY s.request_id
""")

TEXTS = {
    "load_split": """
        SELECT * FROM x_loaded UNION ALL
        (SELECT request_id, 'debug', n_history FROM x_loaded WHERE split = 'train' ORDER BY request_id LIMIT 10)""",
    "chat_inputs": "SELECT conv_id AS request_id, turn::INT AS turn, role, text AS content FROM conversations",
    "chat_files": """
        SELECT turn, role, content, count(*) AS n FROM (
          SELECT (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, text AS content FROM conversations)
        GROUP BY ALL""",
    "prompt_fallback": """
        SELECT c.conv_id AS request_id, coalesce(any_value(d.text), arg_min(c.text, c.turn)) AS prompt
        FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'user' GROUP BY c.conv_id""",
    "system_prompt": "SELECT request_id, mode, system FROM x_system",
    "item_lines": "SELECT request_id, section, pos, item_id, line FROM x_lines",
    "rec_prompt": "SELECT request_id, prompt FROM x_prompt",
    "chat_build": """
        SELECT p.request_id, 0::INT AS turn, 'system' AS role, system AS content FROM x_prompt p JOIN x_system s ON s.request_id = p.request_id
        UNION ALL SELECT request_id, 1, 'user', prompt FROM x_prompt
        UNION ALL SELECT request_id, 2, 'assistant', CASE request_id % 3 WHEN 0 THEN '<output>' WHEN 1 THEN '<thought>' ELSE '' END FROM x_prompt""",
    "ir_prompt": "SELECT request_id, prompt FROM x_irprompt",
    "checklist_dim": f"""
        SELECT request_id, q, side, question FROM (SELECT DISTINCT conv_id AS request_id FROM conversations)
        JOIN (VALUES {_QUESTIONS}) t(k, q, side, question) ON k = request_id % 4""",
    "checklist_chat": f"""
        SELECT request_id, turn, role, CASE WHEN role = 'assistant' THEN {_BLOCK} ELSE content END AS content FROM x_chat
        UNION ALL SELECT request_id, (max(turn) + 1)::INT, 'assistant', {_BLOCK} FROM x_chat GROUP BY request_id
        HAVING count(*) FILTER (WHERE role = 'assistant') = 0""",
    "prompt_sections": """
        SELECT request_id, 'history' AS section, h_end::INT AS s_start, c_start::INT AS s_end FROM x_headers
        UNION ALL SELECT request_id, 'candidate', c_end::INT, size::INT FROM x_headers""",
    "item_blocks": "SELECT request_id, no::INT AS no, item_id, c_start::INT AS c_start, c_end::INT AS c_end FROM x_blocks",
    "span_tokens": "SELECT request_id, no::INT AS no, item_id, ts::INT AS tok_start, te::INT AS tok_end FROM x_spans",
    "align_blocks": "SELECT request_id, item_id, ts::INT AS tok_start, te::INT AS tok_end, section FROM x_aligned",
    "span_pool": f"""
        SELECT request_id, no, {summary('v')} FROM (
          SELECT s.request_id, s.no::INT AS no, list_concat(a.v, b.v) AS v FROM x_spans s
          JOIN x_ptok a ON a.request_id = s.request_id AND a.tok = s.ts JOIN x_ptok b ON b.request_id = s.request_id AND b.tok = s.te)""",
    "rec_entries": f"""
        SELECT a.request_id, coalesce(section, 'candidate') AS section, a.no::INT AS pos, item_id, {summary('v')}
        FROM x_aligned a JOIN x_ppool p ON p.request_id = a.request_id AND p.no = a.no""",
    "ir_candidate_block": r"""
        SELECT request_id, regexp_replace(string_agg(line, chr(10) ORDER BY no), '^\s+|\s+$', '', 'g') AS block FROM x_iblock GROUP BY request_id""",
    "ir_candidates": "SELECT request_id, id, text, c_start::INT AS c_start, c_end::INT AS c_end FROM x_ipass WHERE NOT swallowed",
    "ir_parse": r"""
        SELECT request_id, query, n_expected, n_parsed, CASE WHEN n_expected <> n_parsed
          THEN 'Expected ' || n_expected || ' candidates but parsed ' || n_parsed || '.' END AS warning
        FROM (SELECT p.request_id, any_value(q.query) AS query,
            any_value(regexp_extract(p.prompt, 'provide you with (\d+) passages', 1)::INT) AS n_expected, count(k.id)::INT AS n_parsed
          FROM x_irprompt p JOIN x_iquery q ON q.request_id = p.request_id LEFT JOIN x_ikept k ON k.request_id = p.request_id GROUP BY p.request_id)""",
    "ir_entries": f"""
        SELECT s.request_id, section, id, text, {summary('v')} FROM (
          SELECT request_id, no, 'candidate' AS section, id, text FROM x_ikept
          UNION ALL SELECT request_id, 0, 'query', '', query FROM x_iquery) s
        LEFT JOIN x_ipool p ON p.request_id = s.request_id AND p.no = s.no""",
}
