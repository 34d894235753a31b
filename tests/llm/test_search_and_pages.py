"""Main text, ranked search and hard negatives: against plain versions, and on odd rows."""

import math
import random
import re

import numpy as np
import pytest

from quillspark.llm import hard_negatives, main_text, ranked_search
from quillspark.llm import textkit as tk
from tests.llm.conftest import CLASHING

PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>Not this</title><style>p{{}}</style></head><body class="with-menu">
<div id="cookie-notice">We use cookies for everything you do here and more.</div>
<header><a href="/">Site</a> The site of sites</header><ul class="main-menu"><li><a href=1>One</a><li><a href=2>Two</a></ul>
<main><div class="post-header"><h1>A &amp; B&nbsp;title</h1></div>
<p>First <b>bo</b>ld   paragraph&#33;<br>next line</p><script>if (a < b) document.write("</p><p>no</p>")</script>
<p class="ad">Buy this now and again</p><p>Second one.<p>Third one, open
<ul><li>an item<li>other item</ul><table><tr><td>a</td><td>b</td></tr></table><form><label>Mail</label><input name="x"></form>
<blockquote>quoted {k}</blockquote><div hidden>secret</div><aside>See also these pages</aside></main>
<section id="comments"><h2>Comments</h2><p>I like this very much, it is the best page of all pages.</p></section>
<footer>&copy; somebody, all rights reserved</footer></body></html>"""
WANT = "A & B title\n\nFirst bold paragraph! next line\n\nSecond one.\n\nThird one, open\n\nan item\n\nother item\n\na b\n\nquoted {k}"


def test_main_text_leaves_out_what_is_not_the_article(spark):
    rows = [(k, f"u{k}", PAGE.format(k=k)) for k in range(20)]
    got = main_text.report(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(r.page_id, r.url): (r.text, r.n_chars) for r in got.collect()} == {(k, f"u{k}"): (WANT.format(k=k), len(WANT.format(k=k))) for k in range(20)}


def test_main_text_of_given_pages_is_their_article(spark, sf_dir):
    """A plain reading of the driver's pages: what stands between the article's tags, by paragraph."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in main_text.report(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def best_region(page, weight):
    """All regions in turn: the largest sum, the first of equal ones."""
    parts = [(weight[main_text._feature(n)], "") if n else (len(t.split()) * weight[main_text.LINK_WORD if link else main_text.WORD], t) for n, _, t, bad, link in main_text.tokens(page) if n or (not bad and t.split())]
    best, found = 0.0, ""
    for i in range(len(parts)):
        total = 0.0
        for j in range(i, len(parts)):
            total += parts[j][0]
            if parts[j][1] and total > best:
                best, found = total, " ".join(" ".join(t for _, t in parts[i : j + 1]).split())
    return found


def test_region_is_the_maximum_of_all_regions():
    r = random.Random(4)
    weight = main_text.weights({(main_text.WORD, True): 50, (main_text.WORD, False): 40, (main_text._feature("div"), False): 30, (main_text._feature("a"), False): 9})
    for _ in range(200):
        page = "".join(r.choice(["<div>", "</div>", "<a href=x>", "</a>", "<td>", " one ", " two words ", "<nav>menu</nav>", " a few more words "]) for _ in range(40))
        assert " ".join(main_text.main_text(page, weight).split()) == best_region(page, weight)


def test_odd_pages(spark):
    huge = "<article>" + "<p>word here</p>" * 100_000 + "</article>"
    odd = [None, "", " \n", "<nav>only a menu</nav>", "plain text\n of  words", "<p>open", "<p", "a < b and <3 c", '<div class="x>never closed quote', "<!-- open comment", "<script>open script", "</div></div><p>late</p>", "<b>" * 2000 + "deep", '<a "' * 3000, "=" * 5000 + "<x =\"" * 3000, huge, "&#0;&#xD800;&bogus; x"]
    rows = [(i, None, h, *("c",) * len(CLASHING)) for i, h in enumerate(odd)] + [(4, None, odd[4], *("c",) * len(CLASHING)), (None, None, "<p>x</p>", *("c",) * len(CLASHING))]
    schema = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    got = [(r.page_id, r.text, r.n_chars) for r in main_text.report(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    of = {i: t for i, t, _ in got}
    assert [of[i] for i in (0, 1, 2, 3)] == [""] * 4
    assert of[4] == "plain text of words" and of[5] == "open" and of[7] == "a < b and <3 c" and of[11] == "late" and of[12] == "deep" and of[None] == "x"
    assert of[15] == "\n\n".join(["word here"] * 100_000)
    assert main_text.report(spark.createDataFrame([], schema)).collect() == []


def plain_search(docs, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, words(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    together = {}
    for i, t in items:
        together.setdefault(i, []).extend(words(t))
    out = []
    for i, asked in together.items():
        found = []
        for d, w in own:
            score = 0
            for t in asked:
                if tf := w.count(t):
                    m = 25 + 75 * len(w) * n_docs // n_words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("group_bytes", [ranked_search.GROUP_BYTES, 40])
def test_search_equals_plain_scores(spark, odd, group_bytes):
    items = [(1, "alpha1 beta2 Beta2 tau17 épsilon5"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (5, "one line 3 same mail ÉPSILON épsilon 日本語"), (5, "line"), (None, "x odd"), (7, "a " * 50)]
    docs = odd.where("text IS NULL OR length(text) < 60000")
    got = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), group_bytes=group_bytes)
    want = plain_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_search_takes_long_texts_and_terms_whole(spark):
    long = "filler " * (tk.SLICE_BYTES // 5) + "needle"
    word = "x" * 70_000
    docs = spark.createDataFrame([(1, long), (2, "needle here"), (3, word), (4, word[:-1] + "y")], "doc_id long, text string")
    got = ranked_search.search(docs, spark.createDataFrame([(1, "needle"), (2, word)], "item_id int, text string")).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in got) == [(1, 1, 2), (1, 2, 1), (2, 1, 3)]


def test_search_on_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(items.selectExpr("item_id AS doc_id", "text"), items.where("false")).collect() == []


def plain_negatives(rows):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, v)
        one[i] = min(one.get(i, key), key)
    own = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a, (label, v) in own.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, other) for b, (other, w) in own.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [(-t, b) for t, b, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, b, -s, t) for k, (t, b) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 3])
def test_negatives_equal_all_pairs(spark, block):
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 6))
    rows = [(i, [float(x) for x in centres[i % 4] + r.normal(size=6) * 0.6], int(r.integers(0, 3))) for i in range(700)]
    rows += [(700 + i, rows[50][1], int(rows[50][2])) for i in range(300)]  # copies of an anchor
    rows += [(2000, None, 1), (2050, [1.0] * 6, None), (2100, [float("nan")] * 6, 1), (2150, [1.0, None], 1), (2200, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (2250, [], 1), (2300, [0.5] * 4, 1), (-50, [0.7] * 6, 0), rows[0], (100, [9.0] * 6, 5), (2350, [-3e4, 5e3, 1.0, 2.0, 3.0, 4.0], 2)]
    frame = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, label int, near string").repartition(5)
    got = hard_negatives.mined(frame, block_anchors=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mined(none).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(1, None, 1)], none.schema)).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(1, [1.0], 1)], none.schema)).collect() == []


def test_brackets_hold_every_score():
    r = np.random.default_rng(6)
    v = r.integers(-200, 200, (300, 8))
    most = float((v.astype(float) ** 2).sum(1).max())
    pivots = hard_negatives.pivots_among(v[:50], most)
    rows = hard_negatives.Rows(np.arange(300), np.zeros(300), v, hard_negatives._distances(hard_negatives._lifted(v, most), pivots))
    anchors = rows.part(np.arange(0, 300, 7))
    anchors.distances = hard_negatives._distances(np.concatenate([anchors.v.astype(float), np.zeros((len(anchors.ids), 1))], axis=1), pivots)
    exact = anchors.v @ v.T
    low, high = hard_negatives.brackets(anchors, rows, most)
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 2 * np.abs(exact).max() * 2
    low, high = hard_negatives._block_brackets(anchors, rows, most)
    assert (low <= exact.min(1)).all() and (exact.max(1) <= high).all()
