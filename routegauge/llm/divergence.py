"""How the sources of a language diverge in their vocabulary.

The terms that enough documents of a group use get ordinals in the order of their bytes. Consecutive ordinals form shards
of bounded size, each a minimal acyclic transducer; the texts are streamed through the transducers to count the kept terms
again by source. Ordinals stand for the terms in every later step and decide ties. Transducers are handed to the tasks in
blocks of bounded size: a vocabulary beyond one block takes another pass over the texts of its groups, none is cut.

All figures are integers: shares are parts of a thousand millions, floored, and so are the terms of the divergence.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegauge.llm.common import Kept, slices, stored, text_or_empty
from routegauge.llm.transducer import Transducer, build
from routegauge.operators.ranking import with_rank
from routegauge.session import ship_package

LEAST_DOCUMENTS = 10
SHARD_TERMS = 1 << 16
BLOCK_BYTES = 64 << 20  # transducers broadcast at once
HELD_TERMS = 600_000  # counters of a task before it hands them on
HELD_OCCURRENCES = 4_000_000  # the same for occurrences of kept terms
KEPT_WORDS = 600_000  # words whose ordinals a task remembers, for each language
ORDINALS = 1 << 10  # ordinals of a block of the pair sums
TILE = 64  # sources of a tile of the pair sums, about
TOP = 10
#: Letters are kept, A-Z as a-z; every other ASCII character parts terms.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in their order."""
    return text.translate(_LETTERS).split()  # only spaces are left of ASCII white space


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        langs = [x for lang, found in held.items() for x in [lang] * len(found)]
        words = pa.array([w for found in held.values() for w in found], pa.binary()).cast(pa.string())
        counts = pa.array([n for found in held.values() for n in found.values()], pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), words, counts], names=["lang", "term", "n"])

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[lang].update(set(terms(text.as_py())))
        if sum(map(len, held.values())) > HELD_TERMS:
            yield rows()
    yield rows()


def _plain(docs: DataFrame, group: str, source: str, text: str) -> DataFrame:
    """(lang, source, text) with empty strings for nulls, the text in UTF-8."""
    return docs.select(
        text_or_empty(group).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).cast("binary").alias("text")
    )


def vocabulary(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, ordinal, size): the terms in at least ``least`` rows of a group, their places from 0, and how many they are."""
    found = rows.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n long")
    kept = stored(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).drop("n"), "kept-terms")
    return with_rank(kept, [F.asc("term")], by=("lang",), rank="rn", size="size").select(
        "lang", "term", (F.col("rn") - 1).alias("ordinal"), "size"
    )


def _shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("ordinal")
    words = table.column("term").cast(pa.binary()).to_pylist()
    return pa.table({
        "lang": table.column("lang").slice(0, 1), "base": table.column("ordinal").slice(0, 1),
        "first": pa.array(words[:1], pa.binary()), "automaton": pa.array([build(words).pack()], pa.binary()),
    })


def shards(terms_of: DataFrame) -> DataFrame:
    """(lang, base, first, automaton): one transducer for every run of 65,536 ordinals."""
    numbered = terms_of.select("lang", "term", "ordinal", F.floor(F.col("ordinal") / SHARD_TERMS).alias("shard"))
    return numbered.groupBy("lang", "shard").applyInArrow(_shard, "lang string, base long, first binary, automaton binary")


class _Vocabulary:
    """The transducers of one broadcast, unpacked once per task, and the ordinals of words that texts have had lately."""

    def __init__(self, rows: list[tuple[str, int, bytes, bytes]]):
        self.of: dict[str, tuple[list, list, list, Kept]] = {}
        for lang, base, first, automaton in sorted(rows):
            firsts, bases, automata, _ = self.of.setdefault(lang, ([], [], [], Kept(KEPT_WORDS)))
            firsts.append(first)
            bases.append(base)
            automata.append(Transducer.unpack(automaton))

    def ordinals(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The ordinals of those words that are kept terms."""
        firsts, bases, automata, lately = self.of[lang]
        found = list(map(lately.get, words))
        if None in found:
            for at, word in enumerate(words):
                if found[at] is None:
                    ordinal = lately.get(word)
                    if ordinal is None:
                        ordinal = lately.recall(word)
                    if ordinal is None:
                        i = bisect_right(firsts, word) - 1
                        place = automata[i].ordinal(word) if i >= 0 else -1
                        ordinal = bases[i] + place if place >= 0 else -1
                        lately.enter(word, ordinal)
                    found[at] = ordinal
        out = np.fromiter(found, np.int64, len(found))
        return out[out >= 0]


def _recounted(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Vocabulary(shared.value), 0
        held: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), parts in held.items():
                ordinals, counts = np.unique(np.concatenate(parts), return_counts=True)
                columns = [pa.repeat(lang, len(counts)), pa.repeat(source, len(counts)), pa.array(ordinals), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "ordinal", "n"])
            held.clear()

        for batch in slices(batches):
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            for lang, source, text in zip(*columns, strict=True):
                if lang in known.of:
                    held[lang, source].append(known.ordinals(lang, terms(text.as_py())))
                    total += len(held[lang, source][-1])
            if total > HELD_OCCURRENCES:
                yield from rows()
                total = 0
        yield from rows()

    return apply


def recount(rows: DataFrame, terms_of: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): how often each kept term occurs in the texts of each source.

    The driver holds the sizes of all shards, one row for 65,536 terms, and the transducers of one block.
    """
    spark = rows.sparkSession
    built = stored(shards(terms_of), "term-shards")
    sizes = built.select("lang", "base", F.octet_length("automaton").alias("bytes")).orderBy("lang", "base").collect()
    blocks: list[list[tuple[str, int]]] = []
    used = block_bytes + 1
    for lang, base, size in sizes:
        if used + size > block_bytes:
            blocks.append([])
            used = 0
        blocks[-1].append((lang, base))
        used += size
    found = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for block in blocks:
        low, high = block[0], block[-1]
        after = (F.col("lang") > low[0]) | ((F.col("lang") == low[0]) & (F.col("base") >= low[1]))
        inside = after & ((F.col("lang") < high[0]) | ((F.col("lang") == high[0]) & (F.col("base") <= high[1])))
        automata = [(r["lang"], r["base"], bytes(r["first"]), bytes(r["automaton"])) for r in built.filter(inside).collect()]
        shared = spark.sparkContext.broadcast(automata)
        texts = rows.filter(F.col("lang").between(low[0], high[0]))
        found = found.unionByName(texts.mapInArrow(_recounted(shared), "lang string, source string, ordinal long, n long"))
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: str | Column, total: str, size: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * size)), exact; null where nothing is kept."""
    whole = F.lit(10**9).cast("decimal(38,0)") * ((F.col(count) if isinstance(count, str) else count) + 2)
    return F.when(F.col(size) > 0, F.call_function("div", whole, (F.col(total) + 2 * F.col(size)).cast("decimal(38,0)")) + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(table: pa.Table) -> pa.Table:
    """For the sources of two tiles, the sums over one block of ordinals of what each term adds beyond an absent one."""
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    tile, source, ordinal = (table.column(c).to_pylist() for c in ("tile", "source", "ordinal"))
    p, base = (table.column(c).to_numpy() for c in ("p", "base"))
    places = {x: i for i, x in enumerate(sorted({o for o in ordinal if o >= 0}))}
    sides = [sorted({s for s, t in zip(source, tile, strict=True) if t == side}) for side in (low, high)]
    rows = {(t, s): i for side, names in zip((low, high), sides, strict=True) for i, s in enumerate(names) for t in [side]}
    absent = [np.zeros(len(names), np.int64) for names in sides]
    for t, s, b in zip(tile, source, base, strict=True):
        absent[0 if t == low else 1][rows[t, s]] = b
    if low == high:
        absent[1] = absent[0]
    shares = [np.repeat(a[:, None], len(places), axis=1) for a in absent]
    for t, s, o, x in zip(tile, source, ordinal, p, strict=True):
        if o >= 0:
            shares[0 if t == low else 1][rows[t, s], places[o]] = x
    if low == high:
        shares[1] = shares[0]
    left, right, sums = [], [], []
    for i, name in enumerate(sides[0]):
        rest = slice(i + 1, None) if low == high else slice(None)
        mine, other = shares[0][i], shares[1][rest]
        each = ((mine - other) ** 2 // (mine + other)).sum(axis=1)
        none = (absent[0][i] - absent[1][rest]) ** 2 // (absent[0][i] + absent[1][rest])
        sums += (each - none * len(places)).tolist()
        right += sides[1][rest]
        left += [name] * len(other)
    return pa.table({
        "lang": pa.array([lang] * len(left), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()),
        "beyond": pa.array(sums, pa.int64()),
    })


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language.

    Terms are taken in blocks of ordinals and sources in tiles, so that no task sees more than two tiles by one block.
    """
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    known = groups.withColumns({
        "base": share(F.lit(0), "total", "size"), "tiles": tiles, "tile": F.pmod(F.xxhash64("source"), tiles).cast("int")
    }).filter("size > 0")
    keep = ["lang", "source", "tile", "tiles", "base"]
    block = F.floor(F.col("ordinal") / ORDINALS).alias("block")
    present = counts.join(known, ["lang", "source"]).select(*keep, block, "ordinal", share("n", "total", "size").alias("p"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / ORDINALS))).alias("block")
    fillers = known.select(*keep, every, F.lit(-1).cast("long").alias("ordinal"), F.col("base").alias("p"))
    met = present.unionByName(fillers).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select(
        "lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "source", "base", "ordinal", "p"
    )
    beyond = met.groupBy("lang", "block", "low", "high").applyInArrow(_pair_sums, "lang string, a string, b string, beyond long")
    sums = beyond.groupBy("lang", "a", "b").agg(F.sum("beyond").alias("beyond"))
    one = known.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), "size")
    two = known.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    value = F.col("beyond") + F.col("size") * divergence(F.col("base_a"), F.col("base_b"))
    found = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "a", "b", value.alias("value"))
    bare = groups.filter("size = 0")
    nothing = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang")
    nothing = nothing.filter("a < b").withColumn("value", F.lit(0).cast("long"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.unionByName(nothing).select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(
    docs: DataFrame, group: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a group diverge, and by which terms.

    Part ``pair`` has every other source of the group as item, and the sum of the divergences of all kept terms (0 where
    none is kept). Part ``term`` has the ``top`` terms that the source uses more than the group as a whole. Larger values
    come first, ties in the order of the UTF-8 bytes. Null groups, sources and texts count as empty strings; a source
    without terms has its pairs. Rows that repeat count as documents of their own. Texts are read whole, however long;
    other columns do not matter. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = _plain(docs, group, source, text)
    kept = stored(vocabulary(rows, least), "vocabulary")
    counts = stored(recount(rows, kept.select("lang", "term", "ordinal"), block_bytes), "term-counts")
    sizes = kept.groupBy("lang").agg(F.max("size").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"),
        F.count("*").over(of_lang).alias("sources"), F.coalesce(F.sum("total").over(of_lang), F.lit(0)).alias("lang_total"),
    ), "term-groups")

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    shares = counts.join(groups, ["lang", "source"]).join(whole, ["lang", "ordinal"]).select(
        "lang", "source", "ordinal", share("n", "total", "size").alias("p"), share("lang_n", "lang_total", "size").alias("q")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("ordinal"))
    ranked = shares.filter("p > q").select("lang", "source", "ordinal", divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    named = ranked.join(kept, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = _pairs(counts, groups).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(named)
