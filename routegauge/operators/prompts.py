"""Prompt and chat assembly."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge import fixed_values as fv


def _alias(dataset: Column) -> Column:
    return F.lower(F.coalesce(dataset, F.lit("")))


def system_prompt(
    dataset: Column, mode: Column, direct_system: str | None = None, cot_system: str | None = None
) -> Column:
    """Given prompts for explicit direct/CoT on the two main datasets, else the dataset's own; unknown is an error."""
    name = _alias(dataset)
    own = (
        F.when(name.isin(*fv.MOVIE_ALIASES), F.lit(fv.MOVIE_SYSTEM))
        .when(name.isin(*fv.GAME_ALIASES), F.lit(fv.GAME_SYSTEM))
        .when(name.isin(*fv.IR_ALIASES), F.lit(fv.RANK_SYSTEM))
        .otherwise(F.raise_error(F.concat(F.lit("dataset without a prompt: "), dataset)).cast("string"))
    )
    explicit = name.isin(*fv.REC_KINDS)

    def given(text: str | None) -> Column:
        return F.lit(text) if text is not None else F.raise_error(F.lit("no system prompt given")).cast("string")

    return F.when(explicit & (mode == "direct"), given(direct_system)).when(
        explicit & (mode == "CoT"), given(cot_system)
    ).otherwise(own)


def assistant_prefix(mode: Column) -> Column:
    direct, cot = fv.ASSISTANT_PREFIX["direct"], fv.ASSISTANT_PREFIX["CoT"]
    return F.when(mode == "direct", direct).when(mode == "CoT", cot).otherwise(fv.ASSISTANT_PREFIX["agent"])


def item_lines(listed: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``line`` to rows with item_id and dataset; ids missing from the catalogue print placeholders."""
    known = items.groupBy("item_id").agg(F.min(F.struct("title", "genres")).alias("item"))
    joined = listed.join(known, "item_id", "left")
    name = _alias(F.col("dataset"))
    title = F.coalesce("item.title", F.lit(fv.UNKNOWN_TITLE))
    genres = F.coalesce("item.genres", F.lit(fv.UNKNOWN_GENRES))
    head = F.concat(F.lit(f"{fv.ITEM_MARK}ID:"), F.col("item_id").cast("string"))
    line = (
        F.when(name.isin(*fv.MOVIE_ALIASES), F.concat(head, F.lit(" Title:"), title, F.lit("; Genres:"), genres))
        .when(name.isin(*fv.GAME_ALIASES), F.concat(head, F.lit(" Title:"), title))
        .otherwise(head)
    )
    return joined.withColumn("line", line).drop("item")


def rec_prompt(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """request_id, prompt: history section, then candidate section."""

    def joined(section: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("pos", "line"))))
        return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")

    texts = lines.groupBy("request_id").agg(joined("history").alias("h"), joined("candidate").alias("c"))
    text = F.concat(
        F.lit(fv.HISTORY_HEADER + "\n"), F.coalesce("h", F.lit("")),
        F.lit("\n" + fv.CANDIDATE_HEADER + "\n"), F.coalesce("c", F.lit("")), F.lit("\n"),
    )
    return requests.select("request_id").join(texts, "request_id", "left").select("request_id", text.alias("prompt"))


def ir_prompt(records: DataFrame, layout: str = fv.IR_AGENT_LAYOUT) -> DataFrame:
    """Fill the layout's {task}, {query} and {candidates_block} from retrieval records."""
    source = {"task": "task_desc", "query": "search_query_line", "candidates_block": "options_text"}
    pieces = re.split(r"\{(task|query|candidates_block)\}", layout)
    text = F.concat(*[F.col(source[p]) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
    return records.select("request_id", text.alias("prompt"))


def messages(system: Column, user: Column, prefix: Column | None) -> Column:
    """system and user message, and an assistant message when a prefix is given (even an empty one)."""
    said = [("system", system), ("user", user)] + ([("assistant", prefix)] if prefix is not None else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said])


def chat_rows(chats: DataFrame) -> DataFrame:
    """request_id, turn, role, content of an array column ``chat``."""
    return chats.select("request_id", F.posexplode("chat").alias("turn", "m")).select(
        "request_id", "turn", "m.role", "m.content"
    )


def user_fallback(chats: DataFrame, meta: DataFrame) -> DataFrame:
    """The stored prompt of a request, or its first user message where none is stored."""
    first = chats.filter(F.col("role") == "user").groupBy("request_id").agg(F.min_by("content", "turn").alias("user"))
    return first.join(meta.select("request_id", F.col("prompt").alias("stored")), "request_id", "left").select(
        "request_id", F.coalesce("stored", "user").alias("prompt")
    )


# --- checklist --------------------------------------------------------------------------------------


def checklist_domain(dataset: Column) -> Column:
    name = _alias(F.trim(dataset))
    return F.when(name.isin(*fv.MOVIE_ALIASES), "movie").when(name.isin(*fv.GAME_ALIASES), "game").otherwise("ir")


def _by_domain(dataset: Column, value) -> Column:
    domain = checklist_domain(dataset)
    return F.when(domain == "movie", value("movie")).when(domain == "game", value("game")).otherwise(value("ir"))


def checklist_rows(requests: DataFrame) -> DataFrame:
    """request_id, q, side, question of each request's dataset."""

    def pairs(domain: str) -> Column:
        return F.array(*[
            F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), F.lit(text).alias("question"))
            for q, pair in enumerate(fv.CHECKLIST[domain], 1)
            for side, text in zip(("dir", "cot"), pair)
        ])

    return requests.select("request_id", F.explode(_by_domain(F.col("dataset"), pairs)).alias("x")).select("request_id", "x.*")


def checklist_block(domain: str) -> str:
    lines = list(fv.CHECKLIST_INTRO)
    for i, (direct, cot) in enumerate(fv.CHECKLIST[domain], 1):
        lines += [f"Q{i} (Direct-friendly): {direct}  Answer:", f"Q{i} (CoT-friendly): {cot}  Answer:"]
    return "\n".join([*lines, fv.CHECKLIST_OUTRO])


def with_system(turns: DataFrame, text: str) -> DataFrame:
    """Chats without a system turn get one with the text, and their other turns move up by one."""
    chats = turns.groupBy("request_id", "dataset").agg(F.max((F.col("role") == "system").cast("int")).alias("_has"))
    moved = turns.join(chats.select("request_id", "_has"), "request_id").withColumn("turn", F.col("turn") + 1 - F.col("_has"))
    added = chats.filter(F.col("_has") == 0).select(
        "request_id", "dataset", F.lit(0).alias("turn"), F.lit("system").alias("role"), F.lit(text).alias("content")
    )
    return moved.drop("_has").unionByName(added)


def checklist_chat(turns: DataFrame) -> DataFrame:
    """Every assistant turn becomes the checklist; a chat without one gets it as last turn.

    Rows: request_id, dataset, turn, role, content. A chat needs a system and a user message.
    """
    block = _by_domain(F.col("dataset"), lambda d: F.lit(checklist_block(d)))
    chat = turns.groupBy("request_id", "dataset").agg(
        F.max("turn").alias("last"),
        *[F.max((F.col("role") == r).cast("int")).alias(r) for r in ("system", "user", "assistant")],
    )
    whole = (F.col("system") == 1) & (F.col("user") == 1)
    checked = chat.withColumn(
        "last", F.when(whole, F.col("last")).otherwise(F.raise_error(F.lit("a chat needs system and user")).cast("int"))
    )
    appended = checked.filter(F.col("assistant") == 0).select(
        "request_id", "dataset", (F.col("last") + 1).alias("turn"), F.lit("assistant").alias("role"), block.alias("content")
    )
    kept = turns.join(checked.select("request_id", "last"), "request_id").drop("last")
    replaced = kept.withColumn("content", F.when(F.col("role") == "assistant", block).otherwise(F.col("content")))
    return replaced.unionByName(appended).select("request_id", "turn", "role", "content")
