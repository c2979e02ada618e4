"""Benchmark decontamination by winnowing, in DataFrame functions only.

A k-gram is a run of k words. Of every ``window`` consecutive k-grams the one with the smallest hash is kept, so two
texts that share ``k + window - 1`` words share a kept k-gram at the same place of the shared span. Kept k-grams of
documents and items are joined on their hash; each hit is then extended word by word on both sides (comparing words,
not hashes), and counts if it reaches the wanted length. Items shorter than that length are looked for whole: for
each such length that occurs in the benchmark, every run of so many words is kept (window 1).

The first join moves only hashes and document keys. Texts of the documents that hold some kept k-gram are read again
for the extension. The benchmark side is broadcast only where its counted rows stay within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge.llm.common import fresh, let, lower_ascii, stored, text_or_empty

SPAN = 10
GRAM = 5
BROADCAST_ROWS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # all ASCII but digits and letters


def words(text: str = "text") -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, with A-Z in lower case.

    Lower-casing comes after the split where a text has characters beyond ASCII, so that only such words pay for it.
    """
    t = text_or_empty(text)
    ascii_only = F.octet_length(t) == F.char_length(t)
    split = F.split(F.when(ascii_only, F.lower(t)).otherwise(t), _SEPARATORS)
    return F.array_remove(F.when(ascii_only, split).otherwise(F.transform(split, lower_ascii)), "")


def _runs(values: Column, reach: int, join) -> Column:
    """``join`` over every run of ``reach`` neighbours; runs that would pass the end stand at the tail, to be cut off."""
    return let(values, lambda v: F.transform(v, lambda x, i: join(x, *[F.get(v, i + n) for n in range(1, reach)])))


def gram_hashes(w: Column, k: int) -> Column:
    """Hashes of all k-grams, in order; fewer than k words give none."""
    folded = F.transform(w, lambda x: F.xxhash64(x))
    return F.slice(_runs(folded, k, F.xxhash64) if k > 1 else folded, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))


def window_minima(w: Column, k: int, window: int) -> Column:
    """The distinct hashes that winnowing keeps: the smallest of every ``window`` consecutive k-grams."""
    if window == 1:
        return F.array_distinct(gram_hashes(w, k))
    minima = _runs(gram_hashes(w, k), window, F.least)
    return F.array_distinct(F.slice(minima, 1, F.greatest(F.size(w) - (k + window - 2), F.lit(0))))


def kept_grams(w: Column, k: int, window: int) -> Column:
    """Winnowed k-grams of a word array: array of (k, 0-based place, hash); the leftmost of equal minima is kept."""
    none = F.array().cast("array<struct<k:int,p:int,h:bigint>>")

    def entry(place: Column, value: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), (place - 1).cast("int").alias("p"), value.alias("h"))

    def select(g: Column) -> Column:
        if window == 1:
            return F.transform(g, lambda value, i: entry(i + 1, value))
        starts = F.sequence(F.lit(1), F.size(g) - (window - 1))
        places = F.transform(
            starts,
            lambda j: let(F.slice(g, j, window), lambda s: j - 1 + F.array_position(s, F.array_min(s)).cast("int")),
        )
        return F.transform(F.array_distinct(places), lambda p: entry(p, F.element_at(g, p)))

    return F.when(F.size(w) >= k + window - 1, let(gram_hashes(w, k), select)).otherwise(none)


def _context(w: Column, g: Column, reach: int) -> list[Column]:
    """The words of a k-gram and up to ``reach`` words on either side, nearest first."""
    p, k = g["p"], g["k"]
    left = F.greatest(p - reach, F.lit(0))
    return [
        F.slice(w, p + 1, k).alias("gram"),
        F.reverse(F.slice(w, left + 1, p - left)).alias("left"),
        F.slice(w, p + 1 + k, F.lit(reach)).alias("right"),
    ]


def _common(a: str, b: str) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: F.coalesce(F.nullif(F.array_position(s, F.lit(False)), F.lit(0)) - 1, F.size(s)).cast("int"))


def _covered(spans: Column) -> Column:
    """Number of places in a set of half-open (s, e) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    merged = F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], x["e"]).alias("end"),
        ),
    )
    return merged["n"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def find_hits(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM,
) -> DataFrame:
    """Every extended hit: (key, body, item, s, e), words s to e - 1 of the document lie in windows of the item.

    key is the document's id and body a hash of its text, so rows that repeat both stand here once. Null texts have no
    words; a null item id counts as ''. Rows of the benchmark that repeat id and words count once.
    """
    window = span - gram + 1
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words(item_text).alias("w"))
    items = stored(items.filter(F.size("w") > 0).distinct(), "benchmark-words")
    sizes = items.filter(F.size("w") < span).select(F.size("w").alias("n")).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # fewer than span values
    item_grams = F.when(F.size("w") >= span, kept_grams(F.col("w"), gram, window))
    for n in short:
        item_grams = item_grams.when(F.size("w") == n, kept_grams(F.col("w"), n, 1))
    marks = items.select("item", "w", F.explode(item_grams).alias("g"))
    marks = marks.select("item", F.size("w").alias("n"), "g.k", "g.h", *_context(F.col("w"), F.col("g"), window - 1))
    marks = stored(marks.withColumn("need", F.least("n", F.lit(span))).drop("n").distinct(), "benchmark-marks")

    keyed = docs.select(F.col(f"`{doc_id}`").alias("key"), F.xxhash64(text_or_empty(text)).alias("body"), words(text).alias("w"))
    minima = F.concat(window_minima(F.col("w"), gram, window), *[window_minima(F.col("w"), n, 1) for n in short])
    first = keyed.select("key", "body", F.explode(minima).alias("h"))
    hashes = _small(marks.select("h").distinct(), BROADCAST_ROWS)
    candidates = stored(first.join(hashes, "h", "left_semi").select("key", "body").distinct(), "leak-candidates")

    c = _small(candidates, BROADCAST_ROWS)
    near = keyed.join(c, keyed["key"].eqNullSafe(c["key"]) & (keyed["body"] == c["body"]), "left_semi")
    placed = F.concat(kept_grams(F.col("w"), gram, window), *[kept_grams(F.col("w"), n, 1) for n in short])
    near = near.select("key", "body", "w", F.explode(placed).alias("g")).select(
        "key", "body", "g.p", "g.k", "g.h", *_context(F.col("w"), F.col("g"), window - 1)
    )
    d, m = near.alias("d"), _small(marks, BROADCAST_ROWS // 4).alias("m")
    met = d.join(m, (F.col("d.h") == F.col("m.h")) & (F.col("d.k") == F.col("m.k")) & (F.col("d.gram") == F.col("m.gram")))
    long = F.col("m.need") == span
    reach = met.select(
        "d.key", "d.body", "m.item", "m.need", "d.p", "d.k",
        F.when(long, _common("d.left", "m.left")).otherwise(0).alias("l"),
        F.when(long, _common("d.right", "m.right")).otherwise(0).alias("r"),
    )
    return reach.filter(F.col("l") + F.col("k") + F.col("r") >= F.col("need")).select(
        "key", "body", "item", (F.col("p") - F.col("l")).alias("s"), (F.col("p") + F.col("k") + F.col("r")).alias("e")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per (key, body) with hits: n_hit (distinct hit words), spans (their ranges) and items (sorted ids)."""
    hits = find_hits(docs, benchmark, **options)
    found = hits.groupBy("key", "body").agg(
        F.collect_set(F.struct("s", "e")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    return found.withColumn("n_hit", _covered(F.col("spans")))


def with_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, spans (null without hits), items (empty without) and contaminated.

    Null and empty texts have no words and no hits; an empty table or benchmark gives no hits. Rows that repeat get
    the same answer each. Columns of ``docs`` with the new names are replaced.
    """
    body, key, other, n_hit, spans, items = fresh(docs, "body_", "key_", "other_", "n_hit_", "spans_", "items_")
    found = stored(leaks(docs, benchmark, doc_id=doc_id, text=text, **options), "leaks").select(
        F.col("key").alias(key), F.col("body").alias(other), F.col("n_hit").alias(n_hit), F.col("spans").alias(spans), F.col("items").alias(items)
    )
    rows = docs.withColumns({body: F.xxhash64(text_or_empty(text)), "n_words": F.size(words(text)).cast("long")})
    joined = rows.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (F.col(body) == F.col(other)), "left")
    return joined.withColumns({
        "n_hit": F.coalesce(n_hit, F.lit(0)).cast("long"), "spans": F.col(spans),
        "items": F.coalesce(items, F.array().cast("array<string>")), "contaminated": F.col(n_hit).isNotNull(),
    }).drop(body, key, other, n_hit, spans, items)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark window; all columns as they were."""
    body, key, other = fresh(docs, "body_", "key_", "other_")
    found = stored(leaks(docs, benchmark, doc_id=doc_id, text=text, **options).select("key", "body"), "leaks")
    found = _small(found.select(F.col("key").alias(key), F.col("body").alias(other)), BROADCAST_ROWS)
    rows = docs.withColumn(body, F.xxhash64(text_or_empty(text)))
    hit = F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (F.col(body) == F.col(other))
    return rows.join(found, hit, "left_anti").drop(body)
