"""Prompts, sections and passages; passages against a plain regular-expression reading."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.operators import checklist as C
from routegauge.operators import prompts as Q
from routegauge.operators import spans as S

START = r"^\s*(?:§\s*)?\[[A-Za-z0-9]{1,3}\]\s*(?!>)"
BLOCK = re.compile(r"(?ms)^\s*(?:§\s*)?\[([A-Za-z0-9]{1,3})\]\s*(?!>)(.+?)(?=" + START + r"|\Z)")

BODIES = {
    1: "[A] one\ntwo\n[b] three\n[A] again\n",
    2: "[A]\n[B] swallowed\n[C] c\n",
    3: "intro\n  § [A]   x\n\n\n[B]> not a start\n[C] > is one\n[D]",
    4: "[A]\n\n[B]\n[C]\n[D] last",
    5: "[LONG] no\n[1] digits [2] inside\n[2a]\n",
    6: "no passages at all",
    7: "[A]\n[B]\n\n",
}


def prompts(spark, bodies):
    rows = [(k, f"Task.\n- Search Query:  what is {k}? .\n\n- **Candidate Passages**:\n{b}\n### Constraints\n[Z] outside") for k, b in bodies.items()]
    return spark.createDataFrame(rows, "request_id bigint, prompt string")


def brute(body):
    seen, out = set(), []
    for m in BLOCK.finditer(body):
        text = m.group(2).strip()
        if text and m.group(1).upper() not in seen:
            seen.add(m.group(1).upper())
            out.append((m.group(1).upper(), text))
    return out


def test_passages_match_the_regular_expression(spark):
    got = {}
    for r in S.parsed_passages(prompts(spark, BODIES)).orderBy("request_id", "no").collect():
        got.setdefault(r["request_id"], []).append((r["id"], r["text"]))
    for k, body in BODIES.items():
        assert got.get(k, []) == brute("\n" + body + "\n"), k


def test_passage_spans_point_at_the_text(spark):
    table = prompts(spark, BODIES)
    texts = {r["request_id"]: r["prompt"] for r in table.collect()}
    for r in S.parsed_passages(table).collect():
        assert texts[r["request_id"]][r["c_start"]:r["c_end"]] == r["text"]


def test_query_and_warning(spark):
    table = spark.createDataFrame(
        [(1, "I will provide you with 3 passages\n- Search Query: red shoes .  \n- **Candidate Passages**:\n[A] x"), (2, "nothing")],
        "request_id bigint, prompt string",
    )
    rows = {r["request_id"]: r for r in S.parse_ir(table).collect()}
    assert rows[1]["query"] == "red shoes ." and rows[1]["n_parsed"] == 1
    assert rows[1]["warning"] == "Expected 3 candidates but parsed 1."
    assert rows[2]["query"] == "" and rows[2]["n_expected"] is None and rows[2]["warning"] is None
    span = S.query_span(table).orderBy("request_id").collect()
    text = table.orderBy("request_id").first()["prompt"]
    assert text[span[0]["c_start"]:span[0]["c_end"]] == "red shoes ." and span[1]["c_start"] is None


def test_strict_end_keeps_instructions_out_of_the_last_passage(spark):
    table = spark.createDataFrame([(1, "task", "Search Query: q", "[A] a\n[B] b")], "request_id bigint, task_desc string, search_query_line string, options_text string")
    prompt = Q.ir_prompt(table)
    loose = {r["id"]: r["text"] for r in S.parsed_passages(prompt).collect()}
    strict = {r["id"]: r["text"] for r in S.parsed_passages(prompt, strict=True).collect()}
    assert "When generating" in loose["B"] and strict["B"] == "b"


@pytest.mark.parametrize(
    "text, want",
    [
        ("x\nUser's watched history:\na\nCandidate items:\nb", {"history": "\na\n", "candidate": "\nb"}),
        ("a\n candidate  ITEMS: \nb", {"history": "a\n", "candidate": "\nb"}),
        ("User's watched history:\na", {"history": "\na"}),
        ("a", {}),
    ],
)
def test_sections(spark, text, want):
    df = spark.createDataFrame([(1, text)], "request_id bigint, prompt string")
    got = {r["section"]: text[r["s_start"]:r["s_end"]] for r in S.sections(S.line_table(df)).collect()}
    assert got == want


def test_item_lines_of_each_dataset(spark):
    text = "§ID:1 Title:A; Genres:x\n§ID:2 Title:B\n§ID:3\nID:4"
    df = spark.createDataFrame([(1, text, d) for d in ["ml-1m"]] + [(2, text, "my-amazon-game-2"), (3, text, "steam")], "request_id bigint, prompt string, dataset string")
    got = {}
    for strict in (True, False):
        got = {}
        for r in S.item_blocks(S.line_table(df), strict).collect():
            got.setdefault(r["request_id"], []).append(r["item_id"])
        third = [3] if strict else [1, 2]  # prompts under this name are printed with titles
        assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2], 2: [1, 2], 3: third}


def test_token_spans_and_pooling(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(900, 3)).astype(np.float32)
    # token i covers [5i, 5i + 4); every 10th is special
    tokens = [(1, i, 0 if i % 10 == 0 else 5 * i, 0 if i % 10 == 0 else 5 * i + 4, vecs[i].tolist()) for i in range(900)]
    tok = spark.createDataFrame(tokens, "request_id bigint, tok int, c_start int, c_end int, vec array<float>")
    spans = spark.createDataFrame([(1, 0, 4, 3002), (1, 1, 50, 54), (1, 2, 104, 105), (1, 3, 4400, 9000)], "request_id bigint, no int, c_start int, c_end int")
    got = {r["no"]: (r["tok_start"], r["tok_end"]) for r in S.token_spans(spans, tok, ["no"]).collect()}
    assert got == {0: (1, 599), 3: (881, 899)}  # span 1 meets a special token only, span 2 a gap
    covered = S.token_spans(spans, tok, ["no"])
    mean = {r["no"]: r["vec"] for r in S.pool(covered, tok, ["no"]).collect()}
    assert mean[0] == pytest.approx(vecs[1:600].astype(float).mean(axis=0).tolist())
    both = {r["no"]: r["vec"] for r in S.pool(covered, tok, ["no"], "both").collect()}
    assert both[3] == pytest.approx(np.concatenate([vecs[881], vecs[899]]).astype(float).tolist())


def test_uncovered_passages_keep_a_null_vector(spark):
    table = prompts(spark, {1: "[A] one\n[B] two"})
    text = table.first()["prompt"]
    at = text.index("one")
    tok = spark.createDataFrame([(1, 1, at, at + 3, [1.0, 2.0])], "request_id bigint, tok int, c_start int, c_end int, vec array<float>")
    got = {r["id"]: r["vec"] for r in S.ir_entries(table, tok).collect() if r["section"] == "candidate"}
    assert got == {"A": [1.0, 2.0], "B": None}


def test_system_prompt_rules(spark):
    df = spark.createDataFrame([("ml-1m", "direct"), ("MovieLens", "direct"), ("steam", "CoT"), ("IR", "agent")], "d string, m string")
    got = [r[0] for r in df.select(Q.system_prompt(F.col("d"), F.col("m"), "D", "C")).collect()]
    assert got == ["D", fv.MOVIE_SYSTEM, fv.GAME_SYSTEM, fv.RANK_SYSTEM]
    with pytest.raises(Exception, match="dataset without a prompt"):
        spark.createDataFrame([("books", "agent")], "d string, m string").select(Q.system_prompt(F.col("d"), F.col("m"))).collect()


def test_checklist_fills_or_appends(spark):
    rows = [(1, "ir", 0, "system", "s"), (1, "ir", 1, "user", "u"), (2, "game", 0, "system", "s"), (2, "game", 1, "user", "u"), (2, "game", 2, "assistant", "x")]
    schema = "request_id bigint, dataset string, turn int, role string, content string"
    got = {(r["request_id"], r["turn"]): r["content"] for r in Q.checklist_chat(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 2] == Q.checklist_block("ir") and got[2, 2] == Q.checklist_block("game") and got[1, 1] == "u"
    with pytest.raises(Exception, match="system and user"):
        Q.checklist_chat(spark.createDataFrame(rows[:1], schema)).collect()


def test_two_definitions_of_the_top_margin(spark):
    rows = [(1, q, 0.5, 0.25, m) for q, m in enumerate([-0.9, 0.1, 0.8, 0.2], 1)]
    questions = spark.createDataFrame(rows, "request_id bigint, q int, p_dir double, p_cot double, margin_raw double")
    agg = C.aggregates(questions).first()
    assert agg["top3_margin_mean"] == pytest.approx((-0.9 + 0.8 + 0.2) / 3) and agg["win_count"] == 3
    none = spark.createDataFrame([(1, None, None, None, None)], "request_id bigint, margin_mean_raw double, win_count double, top3_margin_mean double, gap_mean double")
    sel = C.select_margins(questions, none).first()
    assert sel["top3_margin_mean"] == pytest.approx((-0.9 + 0.1 + 0.2) / 3) and sel["mraw_q3"] == 0.8 and sel["gap_mean"] == 0.25
