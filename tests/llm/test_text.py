import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from routegauge.llm import decontamination, html_text, packing, packing_plan, prefix_counts, quality, toxicity, url_filter
from routegauge.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    "", "  a  b", "a<|endoftext|>b <|endoftext|> c<|endof", "don't I'll  x's '\n\n foo\t bar \x1c \x85y\xa0z 　 k", " lead",
    "trail ", "\n", "é́ ①½ 日本語  テスト", "\n\n\nab  \n c", "'re 'r !'s",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    encode = encoder(PATH)
    points = [chr(c) + " " + chr(c) + "a" + chr(c) + "1" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in ODD_TEXTS + points:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_every_prefix_count(library):
    table = prefix_counts.PrefixTable(PATH)
    rng = np.random.default_rng(3)
    letters = list(" \n\t'sdltrevam.,!1é\x1f​日<|>\U0001f600")
    for text in ODD_TEXTS + ["".join(rng.choice(letters, 25)) for _ in range(200)]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert table.counts(text).tolist() == want, ascii(text)


def test_budgets(odd, empty, library):
    got = prefix_counts.with_budgets(odd, PATH, 20).collect()
    texts = [r.text or "" for r in odd.collect()]
    want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert prefix_counts.with_budgets(empty, PATH, 20).count() == 0
    small = odd.filter("length(text) < 300 OR text IS NULL")
    for r in prefix_counts.with_prefix_counts(small, PATH).collect():
        assert len(r.prefix_tokens) in {len(t) for t in texts}


def test_packing_round_trip(odd, empty, library):
    placed = packing.place(packing.tokenised(odd, PATH, capacity=256), ["doc_id", "piece", "ids"], capacity=256)
    rows = placed.collect()
    want = sorted(tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in odd.collect())
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, bytes(r.ids)) for r in rows)
    whole, parts = [], defaultdict(list)
    for none, doc, piece, ids in pieces:  # equal rows repeat every piece
        parts[none, doc, piece].append(ids)
    for (none, doc, piece), ids in parts.items():
        if piece == 0:
            for i, first in enumerate(ids):
                rest, n = first, 1
                while not none and (none, doc, n) in parts:
                    rest, n = rest + parts[none, doc, n][i], n + 1
                whole.append(tuple(np.frombuffer(rest, "<u4").tolist()))
    assert sorted(whole) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    packed = packing.sequences(placed)
    assert sorted(len(r.ids) // 4 for r in packed.collect()) == sorted(ends.values())
    assert packing.place(packing.tokenised(empty, PATH), ["doc_id", "piece"]).count() == 0


@pytest.mark.parametrize("parts", [(2,), (3,), (4,), (8,), (2, 3, 4)])
def test_plan_places_every_item_once(parts):
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plan = packing_plan.make_plan(histogram, 2048, 16, parts)
    seen, used = defaultdict(list), defaultdict(list)
    for length, rank, sequence, count, offset in plan.runs:
        seen[length] += range(rank, rank + count)
        for i in range(count):
            used[sequence + i].append((offset, offset + length))
    assert all(sorted(seen[n]) == list(range(c)) for n, c in histogram.items())
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    bound = -(-int((lengths * counts).sum()) // 2048)
    assert len(used) == plan.sequences <= bound * 1.05


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_leaks_against_brute_force(spark, odd, empty):
    source = [words_of(r.text) for r in odd.filter("length(text) > 200 AND length(text) < 1000").collect()]
    items = [(1, " ".join(source[0][5:30])), (2, " ".join(source[0][20:31])), (3, " ".join(source[1][:10]).upper()), (4, "word3"),
             (5, " ".join(source[2][4:8])), (6, None), (7, "... !"), (8, " ".join(source[3][:9])), (1, " ".join(source[0][5:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.with_leaks(odd, bench).collect()
    assert len(got) == odd.count()
    for r in got:
        w, hit, found = words_of(r.text), set(), set()
        for item, text in items:
            b = words_of(text)
            n = min(len(b), 10)
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))
    assert decontamination.with_leaks(empty, bench).count() == 0
    clean = decontamination.drop_leaks(odd, bench.filter("item_id < 4"))
    assert clean.columns == odd.columns and 0 < clean.count() < odd.count()
    assert decontamination.drop_leaks(odd, bench.limit(0)).count() == odd.count()


def test_url_verdicts(spark):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("a.com", "/en", "block"), ("A.com", "/en", "block"), ("b.org", "", "block"), (None, "/", "block")],
        "host string, path string, action string")
    urls = ["http://x.com/", "HTTPS://www.A.com/english?q#f", "http://a.com", "http://b.org", "ftp://c.b.org/x", "http://xb.org/", "nothing", "",
            None, "http://a.com/en?x=http://b.org/", "http://a.com/en?x=http://b.org/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.with_verdicts(pages, rules).collect()}
    assert [got[i][2] for i in range(len(urls))] == ["com/", "a.com/en", None, "b.org", "b.org", None, None, None, None, "a.com/en", "a.com/en"]
    assert got[1] == ("www.a.com", "/english", "a.com/en", "block") and got[8] == ("", "", None, "allow")
    assert url_filter.with_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.with_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


def test_main_text(spark):
    body = "".join(f"<p>Sentence number {i} of the article &amp; more words in it.<br>Next.</p>" for i in range(6))
    page = (f'<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><a href="/">Menu</a></nav><div class="cookie-notice">We use'
            f' cookies here</div><{{0}}><h1>Head</h1>{body}<aside>Side words</aside><form><p>Name</p></form></{{0}}><div id="comments"><p>first!</p></div>'
            '<footer>&copy; me</footer></body></html>')
    want = "Head\n\n" + "\n\n".join(f"Sentence number {i} of the article & more words in it.\n\nNext." for i in range(6))
    rows = [(1, "u", page.format("article")), (2, "u", page.format("div")), (3, None, None), (4, "u", ""), (5, "u", "<"), (5, "u", "<"),
            (6, "u", "<article><p>open <b>bold")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_text.with_main_text(pages).collect()}
    assert got == {1: want, 2: want, 3: "", 4: "", 5: "<", 6: "open bold"}
    assert html_text.with_main_text(pages.limit(0)).count() == 0


def test_wrappers_stay(spark):
    body = "".join(f"<p>Sentence number {i} of the article and more words in it.</p>" for i in range(8))
    rest = ('<nav><a href="/">Menu</a></nav>', '<div class="sidebar"><p>Side words</p></div><div id="comments"><p>first!</p></div><footer>me</footer>')
    want = "\n\n".join(f"Sentence number {i} of the article and more words in it." for i in range(8))
    wraps = ["<form action='/'>{}</form>", '<div class="has-sidebar">{}</div>', '<div class="content-with-comments">{}</div>',
             '<div class="elementor-widget">{}</div>', '<div id="page-banner-share">{}</div>', "<div>{}</div>"]
    rows = []
    for wrap in wraps:
        for inner in (f"<article>{body}</article>", f"<div>{body}</div>"):
            rows.append((len(rows), "u", f"<html><body>{wrap.format(rest[0] + inner + rest[1])}</body></html>"))
    widgets = body.replace("<p>", '<div class="widget"><p>').replace("</p>", "</p></div>")
    rows.append((len(rows), "u", f"<html><body>{rest[0]}<main>{widgets}</main>{rest[1]}</body></html>"))
    rows.append((len(rows), "u", f"<html><body><main><form>{body}</form></main>{rest[1]}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert {r.text for r in html_text.with_main_text(pages).collect()} == {want}


def test_closed_svg_is_empty():
    for page in ('<p>one</p><svg class="x"/><p>two</p>', "<p>one</p><svg/><p>two</p><svg><text>no</text></svg>"):
        assert html_text.extract(page, {"tag:svg": -0.1, "tag:p": -0.1}) == "one\n\ntwo"


def test_learnt_kinds_and_distinct_pages(spark):
    page = "<body><x-{0}>out out</x-{0}><article><p>in in in</p></article></body>"
    rows = [(page.format("same"),)] * 300 + [(page.format(f"n{i}"),) for i in range(2100)]
    weights = html_text.learn(spark.createDataFrame(rows, "html string"), "html", 5000)
    assert {k for k in weights if "x-" in k} == set() and weights["word:other"] < 0.01 + 1e-9
    half = html_text.learn(spark.createDataFrame(rows[:301], "html string"), "html", 2)
    assert half["word:p"] == html_text.learn(spark.createDataFrame(rows[299:301], "html string"), "html", 2)["word:p"]


def test_models_on_labelled_text(spark, odd, empty):
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = list(rng.choice(vocabulary, 60))
        if i % 4 == 0:
            words[int(rng.integers(60))] = "vile"
            words[int(rng.integers(60))] = "nasty"
        if i % 5 == 0:
            words = [f"{w}!!" for w in words]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(500)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    weights = quality.importance(docs, labels)
    assert all((r.log_weight >= 0) == (r.key % 5 > 0) for r in weights.collect())
    drawn = quality.gumbel_top(weights, 100).collect()
    assert sum(r.selected for r in drawn) == 100 and sorted(r.place for r in drawn) == list(range(1, 601))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert {i for i in range(600) if i % 5} <= kept and len(kept) < 520
    scored = toxicity.score(docs, labels).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored if r.doc_id >= 500]) > 0.95
    for table in (odd, empty):
        assert toxicity.score(table, labels).count() == quality.importance(table, labels).count() == table.count()
        assert quality.keep_good(table, labels.limit(0)).count() == table.count()
        assert {r.score for r in toxicity.score(table, labels.limit(0)).collect()} <= {0.0}


def test_pipeline_stages(spark, tmp_path, odd):
    documents = odd.drop("keep_id", "DIGEST_").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1), (6, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        assert docs.columns == documents.columns
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("body, want", [
    ("<p title=it's>first words here</p><p>second words here</p>", "first words here\n\nsecond words here"),
    ('<p>see <a href="/p?id=ad-12">words</a> more</p>', "see words more"),
    ('<p>see <a href="/x?a=1&id=share me">words</a> more</p>', "see words more"),
    ('<p data-id="notice">kept words</p>', "kept words"),
    ('<div id="social-history"><p>kept words too</p></div>', "kept words too"),
    ('<p class=a"b>odd quote</p><p>next</p>', "odd quote\n\nnext"),
    ("<p x='1' id = \"comments\">gone</p><p>some words that stay</p>", "some words that stay"),
    ('<a title="a > b" class="x">keep &amp; this</a>', "keep & this"),
    ('<div class="ad-banner"><p>buy</p></div><p>some words kept</p>', "some words kept"),
])
def test_attributes_of_ordinary_markup(body, want):
    page = f"<html><body><nav>menu one two</nav><article>{body}</article><footer>end of page</footer></body></html>"
    assert html_text.extract(page, {}) == want


def test_best_run_equals_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        found = [(rng.choice([0, 1]), rng.choice(["p", "div", "a", "x-y"]), "w " * rng.randint(0, 4), rng.random() < 0.3, False) for _ in range(rng.randint(0, 30))]
        value = [html_text._score({}, k, n, d) * (len(w.split()) if k == 0 else 1) for k, n, w, d, _ in found]
        start, end = html_text._best(found, {})
        best = max((sum(value[i:j]) for i in range(len(value)) for j in range(i, len(value) + 1)), default=0.0)
        assert sum(value[start:end]) == pytest.approx(max(best, 0.0))


def test_clashing_names_of_url_filter_and_decontamination(spark, odd):
    pages = odd.select(F.lit("http://a.example.com/en/x").alias("url"), *[F.lit("z").alias(c) for c in ("best_rule_", "url_key", "short", "host", "rule")])
    rules = spark.createDataFrame([("example.com", "/en/", "block")], "host string, path string, action string")
    assert {(r.rule, r.verdict) for r in url_filter.with_verdicts(pages, rules).collect()} == {("example.com/en/", "block")}
    bench = spark.createDataFrame([("b1", "y" * 50_000)], "item_id string, text string")
    clash = odd.withColumns({c: F.lit("z") for c in ("found_n_hit", "found_spans", "n_hit_", "spans", "items_", "key_", "body_", "n_words")})
    hit = [r.doc_id for r in decontamination.with_leaks(clash, bench).filter("contaminated").collect()]
    assert hit == [9]
