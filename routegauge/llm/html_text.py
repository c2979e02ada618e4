"""Main text of HTML pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative. The amounts are learnt from labelled
pages, those that mark their article with an ``article`` or ``main`` element: a word scores by how often words in its
kind of block lie inside the marked region, a tag by how often it lies outside. One linear scan finds the contiguous
region with the highest score. Inside that region the elements that are never text (scripts, forms, menus, adverts,
comments) are left out, and what remains is put into blocks. Names and forms are only a sign: if the elements of one sign
hold most words of the marked region, or of the region that scores best without them, they are wrappers and stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import text_or_empty
from routegauge.session import ship_package

LABELLED = 5_000  # distinct pages that the weights are learnt from, at most about
_SLOTS = 1 << 30
_SPACE = re.compile(r"\s+")
#: A value may be quoted behind ``=`` only; other quotes are plain characters.
_VALUE = r"=\s*(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'<>][^\s<>]*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>=]|{_VALUE}|=)*+)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=][^\s<>/=]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'<>][^\s<>]*+)))?|.", re.S)
_NAMING = {"class", "id", "role"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp",
           "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
_DROPPED = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video"}
_DROPPED_WORDS = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer menu modal nav "
    "navbar navigation newsletter notice popup promo promoted recommended related respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget complementary contentinfo".split()
)
_PARTS = re.compile(r"[_-]+")
_REGION = {"article", "main"}
_KNOWN = set(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code "
    "col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr "
    "noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_DIGITS = re.compile(r"\d+")  # numbered names are one sign

# A page is read as events: (kind, block or tag, text, signs of the elements it lies in, inside a marked region)
_WORD, _TAG = 0, 1
_NEVER = "never text"  # the sign that always drops


def naming(attributes: str) -> list[str]:
    """The words of the class, id and role attributes of a tag, in lower case; other attributes and their values do not count."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1] is not None and m[1].lower() in _NAMING:
            found += next((v for v in m.groups()[1:] if v is not None), "").lower().split()
    return found


def signs_of(names: list[str], within: bool) -> frozenset[str]:
    """Names that mark an element as no text. Within a marked region all parts of a name must say so, elsewhere one of them."""
    every = all if within else any
    found = []
    for name in names:
        parts = [p for p in _PARTS.split(_DIGITS.sub("", name)) if p]
        if parts and every(p in _DROPPED_WORDS for p in parts):
            found.append(_DIGITS.sub("", name))
    return frozenset(found)


def events(page: str) -> Iterator[tuple[int, str, str, frozenset[str], bool]]:
    """Words (one event per run of text) and tags of a page in order; broken markup is read as far as it goes."""
    stack: list[tuple[str, frozenset[str], bool, bool]] = []  # tag, signs, marked, is a block
    at, n = 0, len(page)
    none: frozenset[str] = frozenset()
    block, signs, marked = "", none, False

    def settle() -> tuple[str, frozenset[str], bool]:
        block = next((t for t, _, _, b in reversed(stack) if b), "")
        return block, stack[-1][1] if stack else none, bool(stack) and stack[-1][2]

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield _WORD, block, page[at:start], signs, marked
        if start == n:
            return
        m = _TOKEN.match(page, start)
        if m is None:  # a lone sign
            yield _WORD, block, "<", signs, marked
            at = start + 1
            continue
        at = max(m.end(), start + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            block, signs, marked = settle()
            yield _TAG, tag, "/", signs, marked
            continue
        names = naming(m[3]) if "=" in m[3] else []
        more = none
        if tag in _DROPPED or (tag == "header" and not marked):
            more = frozenset([_NEVER])
        elif tag == "form":
            more = frozenset(["form"])
        elif names and tag not in ("html", "body") and tag not in _REGION:
            more = signs_of(names, marked)
        yield _TAG, tag, " ".join(names), signs | more, marked or tag in _REGION
        if tag == "svg" and m[3].endswith("/"):  # the slash counts in foreign elements only
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and any(t == tag for t, _, _, b in stack[-3:]):
            for i in range(len(stack) - 1, -1, -1):  # these close an open one of their kind
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        block, signs, marked = settle()
        signs, marked = signs | more, marked or tag in _REGION
        stack.append((tag, signs, marked, tag not in _INLINE))
        if tag not in _INLINE:
            block = tag


def _kind(kind: int, name: str, dropped: bool) -> str:
    name = name if name in _KNOWN or not name else "other"  # names are free, so unknown ones are one kind
    return f"{'word' if kind == _WORD else 'tag'}:{name}{':odd' if dropped else ''}"


def _wrappers(found: list[tuple[int, str, str, frozenset[str], bool]]) -> frozenset[str]:
    """Signs whose elements hold more than half of the words that are not dropped in any case."""
    total, under = 0, {}
    for kind, _, words, signs, _ in found:
        if kind == _WORD and _NEVER not in signs:
            n = len(words.split())
            total += n
            for sign in signs:
                under[sign] = under.get(sign, 0) + n
    return frozenset(sign for sign, n in under.items() if 2 * n > total)


def settled(page: str, weights: dict[str, float]) -> list[tuple[int, str, str, bool, bool]]:
    """The events of a page with (dropped) in place of the signs: whether one of them is not that of a wrapper."""
    found = list(events(page))
    if any(signs for _, _, _, signs, _ in found):
        region = [e for e in found if e[4]]
        if not any(e[0] == _WORD and _NEVER not in e[3] and e[2].strip() for e in region):
            plain = [(kind, name, words, _NEVER in signs, marked) for kind, name, words, signs, marked in found]
            start, end = _best(plain, weights)
            region = found[start:end]
        stay = _wrappers(region)
    else:
        stay = frozenset()
    return [(kind, name, words, bool(signs - stay), marked) for kind, name, words, signs, marked in found]


def learn(pages: DataFrame, text: str, labelled: int) -> dict[str, float]:
    """Score of every kind of event: words from 0 to 1, tags from -1 to 0, by the share inside the marked regions."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for body in batch.column(0):
                for kind, name, words, dropped, marked in settled(body.as_py(), {}):
                    n = len(words.split()) if kind == _WORD else 1
                    if n:
                        key = _kind(kind, name, dropped), marked
                        counts[key] = counts.get(key, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())],
            names=["kind", "marked", "n"],
        )

    body = text_or_empty(text)
    marked = pages.select(body.alias("body")).filter(F.lower("body").rlike("<(article|main)[\\s>]"))
    total = marked.agg(F.count_distinct(F.xxhash64("body"))).first()[0]
    share = int(_SLOTS * min(1.0, labelled / max(total, 1)))
    sample = marked.filter(F.pmod(F.xxhash64("body"), F.lit(_SLOTS)) < share).distinct()
    counted = sample.mapInArrow(apply, "kind string, marked boolean, n long").groupBy("kind").agg(
        F.sum(F.when(F.col("marked"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")
    )
    rows = counted.collect()  # kinds, not pages: four for every known tag name at most
    out = {}
    for kind, inside, n in rows:
        share_in = (inside + 0.5) / (n + 1)
        out[kind] = max(share_in, 0.01) if kind.startswith("word") else -max(1 - share_in, 0.01)
    return out


def _score(weights: dict[str, float], kind: int, name: str, dropped: bool) -> float:
    known = weights.get(_kind(kind, name, dropped))
    if known is not None:
        return known
    if kind == _WORD:
        return 0.05 if dropped else 0.6
    return -0.8 if dropped else (-0.1 if name in _INLINE or name == "p" else -0.5)


def _best(found: list[tuple[int, str, str, bool, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """Start and end of the events with the highest score."""
    best, best_from, best_to = 0.0, 0, 0
    total, start = 0.0, 0
    for i, (kind, name, words, dropped, _) in enumerate(found):
        value = _score(weights, kind, name, dropped)
        total += value * (len(words.split()) if kind == _WORD else 1)
        if total > best:
            best, best_from, best_to = total, start, i + 1
        if total <= 0:
            total, start = 0.0, i + 1
    return best_from, best_to


def extract(page: str, weights: dict[str, float]) -> str:
    """The main text: blocks joined by an empty line; empty if the page has no text."""
    found = settled(page, weights)
    best_from, best_to = _best(found, weights)
    blocks, parts = [], []
    for kind, name, words, dropped, _ in found[best_from:best_to]:
        if kind == _TAG:
            if name not in _INLINE:
                blocks.append("".join(parts))
                parts = []
        elif not dropped:
            parts.append(words)
    blocks.append("".join(parts))
    tidy = (_SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n\n".join(b for b in tidy if b)


def with_main_text(pages: DataFrame, page: str = "html", labelled: int = LABELLED, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every row and text, the main text of its page.

    Null and empty pages, and pages without words, have an empty text. Without any labelled page fixed scores are used. Repeated
    rows get the same answer each; a page without a marked region is read like all others. Pages are read whole, however
    long; other columns do not matter. An empty table gives no rows.
    """
    ship_package(pages.sparkSession)
    weights = learn(pages, page, labelled)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), weights) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(page).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(apply, schema)
