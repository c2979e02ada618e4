"""Sections, item lines and passages of prompts, and the tokens they cover.

Prompts are taken apart into lines with character offsets; a line table of one prompt is one window.
"""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge import fixed_values as fv
from routegauge.functions import matrices as M
from routegauge.functions import vectors as V
from routegauge.functions.token_spans import covered as token_spans_of
from routegauge.session import materialise

WIDTH = 256  # characters (or tokens) per bucket of the overlap join
POOL = 256  # token vectors summed in one step


def line_table(prompts: DataFrame) -> DataFrame:
    """request_id, size, no, line, c_start, c_end plus the other columns of the prompt table."""
    others = [c for c in prompts.columns if c not in ("request_id", "prompt")]
    lines = prompts.select(
        "request_id", *others, F.length("prompt").alias("size"), F.posexplode(F.split("prompt", "\n", -1)).alias("no", "line")
    )
    upto = Window.partitionBy("request_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("line") + 1).over(upto) - 1
    return lines.withColumn("c_end", end.cast("int")).withColumn("c_start", F.col("c_end") - F.length("line"))


# --- recommendation prompts -------------------------------------------------------------------------


def sections(lines: DataFrame) -> DataFrame:
    """request_id, section, s_start, s_end; which headers exist decides among the four layouts."""
    h, c = F.col("line").rlike(fv.HISTORY_HEADER_LINE), F.col("line").rlike(fv.CANDIDATE_HEADER_LINE)
    found = lines.groupBy("request_id").agg(
        F.max("size").alias("size"),
        F.min(F.when(h, F.col("c_end"))).alias("h_end"),
        F.min(F.when(c, F.col("c_start"))).alias("c_start"),
        F.min(F.when(c, F.col("c_end"))).alias("c_end"),
    )
    has_h, has_c = F.col("h_end").isNotNull(), F.col("c_end").isNotNull()
    history = F.when(has_c, F.struct(F.coalesce("h_end", F.lit(0)).alias("a"), F.col("c_start").alias("b"))).when(
        has_h, F.struct(F.col("h_end").alias("a"), F.col("size").alias("b"))
    )
    candidate = F.when(has_c, F.struct(F.col("c_end").alias("a"), F.col("size").alias("b")))
    parts = F.array(
        F.struct(F.lit("history").alias("section"), history.alias("r")),
        F.struct(F.lit("candidate").alias("section"), candidate.alias("r")),
    )
    return found.select("request_id", F.explode(parts).alias("p")).filter(F.col("p.r").isNotNull()).select(
        "request_id", "p.section", F.col("p.r.a").alias("s_start"), F.col("p.r.b").alias("s_end")
    )


def item_pattern(dataset: Column, strict: bool = False) -> dict[str, Column]:
    """Which line pattern a dataset uses: by a part of its name or a name prompts are rendered under, else the generic one.

    ``strict`` goes by the parts of the name alone.
    """
    name = F.lower(F.coalesce(dataset, F.lit("")))
    game = name.contains("amazon-game")
    movie = name.contains("ml-1m") | name.contains("ml1m")
    if not strict:
        game, movie = game | name.isin(*fv.GAME_ALIASES), movie | name.isin(*fv.MOVIE_ALIASES)
    movie = ~game & movie
    return {fv.MOVIE_ITEM_LINE: movie, fv.GAME_ITEM_LINE: game, fv.GENERIC_ITEM_LINE: ~game & ~movie}


def item_blocks(lines: DataFrame, strict: bool = False) -> DataFrame:
    """request_id, no, item_id, c_start, c_end of the item lines; needs the column dataset."""
    patterns = item_pattern(F.col("dataset"), strict)
    item = F.coalesce(*[
        F.when(applies & F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for p, applies in patterns.items()
    ])
    return lines.withColumn("item_id", item.try_cast("bigint")).filter(F.col("item_id").isNotNull()).select(
        "request_id", "no", "item_id", "c_start", "c_end"
    )


# --- spans and tokens -------------------------------------------------------------------------------


def overlap_join(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str]) -> DataFrame:
    """Pairs of one request whose half-open ranges overlap, each pair once.

    Ranges meet under the bucket of the later start, so the join is an equi-join whose groups stay small
    however long a prompt is.
    """

    def buckets(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / WIDTH), F.floor((F.col(b) - 1) / WIDTH)))

    lb = left.filter(F.col(l[1]) > F.col(l[0])).withColumn("_b", buckets(*l))
    rb = right.filter(F.col(r[1]) > F.col(r[0])).withColumn("_b", buckets(*r))
    meets = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]))
    once = F.col("_b") == F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / WIDTH)
    return lb.join(rb, ["request_id", "_b"]).filter(meets & once).drop("_b")


def token_spans(spans: DataFrame, tokens: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Add tok_start and tok_end, the first and last token a span overlaps; special tokens (0, 0) never count."""
    offsets = tokens.filter((F.col("c_start") != 0) | (F.col("c_end") != 0)).select(
        "request_id", "tok", F.col("c_start").alias("_ts"), F.col("c_end").alias("_te")
    )
    pairs = overlap_join(spans.select("request_id", *key, "c_start", "c_end"), offsets, ("c_start", "c_end"), ("_ts", "_te"))
    ends = pairs.groupBy("request_id", *key).agg(F.min("tok").alias("tok_start"), F.max("tok").alias("tok_end"))
    return spans.join(ends, ["request_id", *key], how)


def align(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Add the section a block starts in; history wins, outside of both it is NULL."""
    wide = parts.groupBy("request_id").agg(*[
        F.max(F.when(F.col("section") == s, F.col(c))).alias(f"{s}_{c}") for s in ("history", "candidate") for c in ("s_start", "s_end")
    ])

    def inside(s: str) -> Column:
        return (F.col(f"{s}_s_start") <= F.col("c_start")) & (F.col("c_start") < F.col(f"{s}_s_end"))

    section = F.when(inside("history"), "history").when(inside("candidate"), "candidate")
    joined = blocks.join(wide, "request_id", "left").withColumn("section", section)
    return joined.select(*blocks.columns, "section")


def pool(spans: DataFrame, tokens: DataFrame, key: list[str], strategy: str = "mean") -> DataFrame:
    """request_id, key, vec: mean, start, end or both (start then end) of the token vectors of a span."""
    keys = ["request_id", *key]
    vectors = tokens.select("request_id", "tok", "vec")
    if strategy in ("start", "end", "both"):
        ends = {
            e: spans.join(vectors, (spans["request_id"] == vectors["request_id"]) & (spans[f"tok_{e}"] == vectors["tok"]))
            .select(*[spans[k] for k in keys], F.col("vec").cast("array<double>").alias(f"_{e}"))
            for e in ("start", "end") if strategy in (e, "both")
        }
        if strategy != "both":
            return ends[strategy].withColumnRenamed(f"_{strategy}", "vec")
        return ends["start"].join(ends["end"], keys).select(*keys, F.concat("_start", "_end").alias("vec"))
    ranges = spans.select(*keys, F.col("tok_start").alias("_s"), (F.col("tok_end") + 1).alias("_e"))
    covered = overlap_join(ranges, vectors.withColumn("_next", F.col("tok") + 1), ("_s", "_e"), ("tok", "_next"))
    # Bounded steps first: a long passage is summed in pieces of POOL tokens on many tasks.
    steps = covered.groupBy(*keys, F.floor(F.col("tok") / POOL).alias("_step")).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_list("vec").alias("m")
    ).select(*keys, "_n", M.vector_total("m").alias("t"))
    sums = steps.groupBy(*keys).agg(F.sum("_n").alias("_n"), V.sum_vector(F.col("t")).alias("t"))
    return sums.select(*keys, F.transform("t", lambda x: x / F.col("_n")).alias("vec"))


def rec_entries(prompts: DataFrame, tokens: DataFrame, strategy: str = "mean") -> DataFrame:
    """Entry vectors of recommendation prompts; uncovered items are dropped, unsectioned ones are candidates."""
    lines = line_table(prompts)
    spans = token_spans(item_blocks(lines), tokens, ["no"])
    aligned = materialise(align(spans, sections(lines)), "item-spans")  # read by pooling and by the join after it
    pooled = pool(aligned, tokens, ["no"], strategy)
    return aligned.join(pooled, ["request_id", "no"]).select(
        "request_id", F.coalesce("section", F.lit("candidate")).alias("section"), F.col("no").alias("pos"), "item_id", "vec"
    )


# --- retrieval prompts ------------------------------------------------------------------------------

_STRIP = r"\A\s+|\s+\z"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def candidate_lines(prompts: DataFrame, strict: bool = False) -> DataFrame:
    """Lines between the passages header and the first later end header (or the end of the prompt).

    ``strict`` also ends at the instruction line after the passages, which otherwise joins the last one.
    """
    lines = line_table(prompts)
    request = Window.partitionBy("request_id")
    ends = F.col("line").rlike(fv.PASSAGES_END_LINE)
    if strict:
        ends = ends | F.col("line").startswith("When generating")
    marked = lines.withColumn("_head", F.min(F.when(F.col("line").rlike(fv.PASSAGES_HEADER_LINE), F.col("no"))).over(request))
    marked = marked.withColumn("_stop", F.min(F.when(ends & (F.col("no") > F.col("_head")), F.col("no"))).over(request))
    inside = (F.col("no") > F.col("_head")) & (F.col("_stop").isNull() | (F.col("no") < F.col("_stop")))
    return marked.filter(inside).drop("_head", "_stop")


def candidate_block(prompts: DataFrame) -> DataFrame:
    """request_id, block: the stripped text between the headers."""
    joined = candidate_lines(prompts).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("no", "line"))).alias("l"))
    return joined.select("request_id", _strip(F.array_join(F.col("l.line"), "\n")).alias("block"))


def passages(prompts: DataFrame, strict: bool = False) -> DataFrame:
    """request_id, no, id, text, c_start, c_end of every passage, empty texts included.

    A start line without any text swallows the next start line, which then is its text.
    """
    starts = F.col("line").rlike(fv.PASSAGE_START_LINE)
    upto = Window.partitionBy("request_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = candidate_lines(prompts, strict).withColumn("no_start", F.sum(starts.cast("int")).over(upto))
    body = F.when(starts, F.regexp_replace("line", fv.PASSAGE_START_LINE, "")).otherwise(F.col("line"))
    lead = F.col("c_end") - F.length(F.regexp_replace(body, r"\A\s+", ""))
    blank = ~body.rlike(r"\S")
    texts = numbered.filter(F.col("no_start") > 0).groupBy("request_id", "no_start").agg(
        F.sort_array(F.collect_list(F.struct("no", "line", body.alias("body")))).alias("l"),
        F.min(F.when(~blank, lead)).alias("first"),
        F.min(F.when(starts, F.col("c_start"))).alias("line_start"),
        F.max(F.when(F.col("line").rlike(r"\S"), F.col("c_start") + F.length(F.regexp_replace("line", r"\s+\z", "")))).alias("last"),
    ).select(
        "request_id", "no_start", "first", "last", "line_start",
        F.upper(F.regexp_extract(F.get("l.line", F.lit(0)), fv.PASSAGE_START_LINE, 1)).alias("id"),
        _strip(F.array_join(F.col("l.line"), "\n")).alias("raw"),
        _strip(F.array_join(F.col("l.body"), "\n")).alias("own"),
    )
    order = Window.partitionBy("request_id").orderBy("no_start")
    filled = F.max(F.when(F.col("own") != "", F.col("no_start"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.col("no_start") - 1 - F.coalesce(filled, F.lit(0))
    resolved = texts.withColumns({
        "taken": run % 2 == 1,  # swallowed by the empty start before it
        "next_raw": F.lead("raw").over(order), "next_start": F.lead("line_start").over(order), "next_last": F.lead("last").over(order),
    })
    empty = F.col("own") == ""
    return resolved.filter(~F.col("taken")).select(
        "request_id", F.col("no_start").alias("no"), "id",
        F.when(empty, F.coalesce("next_raw", F.lit(""))).otherwise(F.col("own")).alias("text"),
        F.when(empty, F.col("next_start")).otherwise(F.col("first")).cast("int").alias("c_start"),
        F.when(empty, F.col("next_last")).otherwise(F.col("last")).cast("int").alias("c_end"),
    )


def parsed_passages(prompts: DataFrame, strict: bool = False) -> DataFrame:
    """Passages with text, the first one of each id."""
    again = Window.partitionBy("request_id", "id").orderBy("no")
    texts = passages(prompts, strict).filter(F.col("text") != "")
    return texts.withColumn("_n", F.row_number().over(again)).filter(F.col("_n") == 1).drop("_n")


def query_span(prompts: DataFrame, keep: list[str] = ()) -> DataFrame:
    """request_id, query, c_start, c_end and the columns kept; an empty query has no span."""
    lead = fv.QUERY_TEXT.replace("(.+?)\\s*$", "")
    before = F.length(F.regexp_extract("prompt", r"(?s)\A(.*?)(?=" + lead + r")", 1))
    head = F.length(F.regexp_extract("prompt", lead + r"(?=.)", 0))
    text = F.regexp_extract("prompt", fv.QUERY_TEXT, 1)
    found = text != ""
    return prompts.select("request_id", *keep, _strip(text).alias("query"), F.when(found, before + head).alias("c_start")).withColumn(
        "c_end", F.col("c_start") + F.length("query")
    )


def parse_ir(prompts: DataFrame, strict: bool = False) -> DataFrame:
    """request_id, query, n_expected, n_parsed, warning."""
    counts = parsed_passages(prompts, strict).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    announced = F.regexp_extract("prompt", fv.PASSAGE_COUNT, 1)
    expected = F.when(announced != "", announced.try_cast("int"))
    joined = prompts.select("request_id", expected.alias("n_expected")).join(
        query_span(prompts).select("request_id", "query"), "request_id"
    ).join(counts, "request_id", "left")
    parsed = F.coalesce("n", F.lit(0)).cast("int")
    warning = F.concat(
        F.lit("Expected "), F.col("n_expected").cast("string"), F.lit(" candidates but parsed "), parsed.cast("string"), F.lit(".")
    )
    return joined.select(
        "request_id", "query", "n_expected", parsed.alias("n_parsed"), F.when(F.col("n_expected") != parsed, warning).alias("warning")
    )


def ir_entries(prompts: DataFrame, tokens: DataFrame, strategy: str = "mean") -> DataFrame:
    """Entry vectors of retrieval prompts; a span no token covers keeps a NULL vector. no 0 is the query."""
    query = query_span(prompts).select(
        "request_id", F.lit(0).cast("bigint").alias("no"), F.lit("").alias("id"), F.col("query").alias("text"), "c_start", "c_end"
    )
    spans = materialise(parsed_passages(prompts).unionByName(query), "passage-spans")  # read twice below
    covered = token_spans(spans.filter(F.col("c_start").isNotNull()), tokens, ["no"])
    pooled = pool(covered.select("request_id", "no", "tok_start", "tok_end"), tokens, ["no"], strategy)
    return spans.join(pooled, ["request_id", "no"], "left").select(
        "request_id", F.when(F.col("no") == 0, "query").otherwise("candidate").alias("section"), "no", "id", "text", "vec"
    )


# --- spans of whole prompts -------------------------------------------------------------------------


def _listed(spans: DataFrame) -> DataFrame:
    columns = [c for c in spans.columns if c != "request_id"]
    return spans.groupBy("request_id").agg(F.collect_list(F.struct(*columns)).alias("spans"))


def _each(found: DataFrame) -> DataFrame:
    one = found.select("request_id", F.explode(F.arrays_zip("spans", "found")).alias("x"))
    return one.select("request_id", "x.spans.*", "x.found.*")


def rec_spans_of(prompts: DataFrame, table: Broadcast, numbers: int, strategy: str | None = None) -> DataFrame:
    """request_id, no, item_id, c_start, c_end, section, tok_start, tok_end, vec of the covered item lines.

    Tokens are found and pooled prompt by prompt, so that neither they nor their vectors are written or sent.
    """
    lines = line_table(prompts)
    listed = _listed(align(item_blocks(lines), sections(lines)))
    rows = prompts.select("request_id", "prompt").join(listed, "request_id")
    return _each(token_spans_of(rows, table, numbers, strategy)).filter(F.col("tok_start").isNotNull())


def ir_entries_of(prompts: DataFrame, table: Broadcast, numbers: int, strategy: str = "mean") -> DataFrame:
    """``ir_entries`` prompt by prompt."""
    query = F.struct(
        F.lit(0).cast("bigint").alias("no"), F.lit("").alias("id"), F.col("query").alias("text"), F.col("c_start").cast("int").alias("c_start"),
        F.col("c_end").cast("int").alias("c_end"),
    )
    asked = query_span(prompts, ["prompt"]).select("request_id", "prompt", F.array(query).alias("own"))
    texts = parsed_passages(prompts).select("request_id", F.col("no").cast("bigint").alias("no"), "id", "text", "c_start", "c_end")
    rows = asked.join(_listed(texts), "request_id", "left").select(
        "request_id", "prompt", F.when(F.col("spans").isNull(), F.col("own")).otherwise(F.concat("own", "spans")).alias("spans")
    )
    return _each(token_spans_of(rows, table, numbers, strategy)).select(
        "request_id", F.when(F.col("no") == 0, "query").otherwise("candidate").alias("section"), "no", "id", "text", "vec"
    )
