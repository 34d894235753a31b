"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; one linear scan
finds the contiguous region with the largest sum, and the region's text is the result. The
weights come from labelled pages, which are pages that mark their article themselves (exactly
one ``article``, or else one ``main``): a word class (plain, in a link) or a tag name weighs the
logarithm of how much more often it stands inside that element than outside. Counts cover all
labelled pages; they are one row for each tag name of ``TAGS`` and word class.

Elements that name themselves boilerplate (``nav``, ``footer``, ``aside``, ``form``, roles, or class
and id names of ``BOILERPLATE``), scripts, styles and hidden elements give no words, wherever they
stand; their tags count. The text of the region keeps page order: block elements separate
blocks, inline tags separate nothing, ``br`` and table cells are white space.

Defined results: null and empty pages, and pages without a word outside boilerplate, give an empty
text. Of equal regions the first one is taken. Pages of any length are scanned whole, in one linear
pass. Repeated rows and ids give a row each; a null id or address stays null. An empty table gives
no rows, and a table without labelled pages is scored by the prior counts alone. Extra columns,
whatever their names, are not read. Unclosed elements end with the element around them;
markup that is not closed at all ends the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textkit import give_back

# Names of elements in HTML and names that sites give to what is not the article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th wbr".split())
CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title template noscript iframe object svg math canvas video audio textarea select noframes noembed xmp".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search button label fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar submenu
    header masthead footer sidebar aside banner cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog form login
    signin signup register subscribe subscription newsletter search comment comments disqus reply replies respond discussion share sharing social
    related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar skip copyright disclaimer""".split()
)
READER_COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
OF_ARTICLE = frozenset("article post entry story page section title".split())
UNLESS_AFTER = frozenset("with has no without is not".split())

TAGS = tuple(sorted((BLOCKS | SPACES | CONTAINERS | BOILERPLATE_TAGS | frozenset("a abbr b cite code em i img input small span strong sub sup u".split())) - {"html", "body"}))
_OTHER = len(TAGS)
_TAG_AT = {name: k for k, name in enumerate(TAGS)}
WORD, LINK_WORD = _OTHER + 1, _OTHER + 2
FEATURES = LINK_WORD + 1

#: Each feature starts with so many occurrences on the side that its kind suggests, and with one on the other.
PRIOR = 8.0
WORD_RANGE, LINK_RANGE, TAG_RANGE = (0.2, 3.0), (0.05, 3.0), (-2.0, -0.05)

_MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?)*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS: dict[str, re.Pattern] = {}


def _named_boilerplate(value: str, only: frozenset[str]) -> bool:
    """Whether a class or id value has a name of ``only``; 'with-sidebar' and 'article-header' are no such names."""
    for name in value.split():
        parts = [p.lower() for p in _NAMES.findall(name)]
        found = only.intersection(parts)
        if found and parts[0] not in UNLESS_AFTER and not (found == {"header"} and OF_ARTICLE.intersection(parts)):
            return True
    return False


def _boilerplate(name: str, attributes: str, inside_article: bool) -> bool:
    if name in BOILERPLATE_TAGS or name == "header" and not inside_article:
        return True
    if not attributes or attributes.isspace():
        return False
    only = READER_COMMENTS if name in ("article", "main") else BOILERPLATE
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if _named_boilerplate(value, only):
                return True
        elif key == "role":
            if value.strip().lower() in BOILERPLATE_ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, bool, str, bool, bool]]:
    """``(tag name, closing, text, boilerplate, in a link)`` in page order; for text the name is empty.

    One pass: an element of ``UNREAD`` is skipped to its end, and only containers and boilerplate elements are kept on a stack.
    """
    stack: list[tuple[str, bool]] = []
    held: Counter[str] = Counter()
    bad = articles = 0
    link = False
    at, n = 0, len(page)

    def pop() -> None:
        nonlocal bad, articles
        name, was = stack.pop()
        held[name] -= 1
        bad -= was
        articles -= name in ("article", "main")

    while at < n:
        m = _MARKUP.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield "", False, page[at:end], bad > 0, link
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue  # a comment, a declaration or a bogus one
        name, closing = m[2].lower(), bool(m[1])
        if not m[4]:
            return  # a tag that never ends
        if closing:
            if name == "a":
                link = False
            yield name, True, "", bad > 0, link
            if held[name] and (name in CONTAINERS or not any(x in CONTAINERS for x, _ in stack[-1:])):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in UNREAD:
            if name not in _ENDS:
                _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)
            if not m[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                over = _ENDS[name].search(page, at)
                at = over.end() if over else n
            continue
        if name in BLOCKS and stack and stack[-1][0] in ("p", "li", "dt", "dd") and (stack[-1][0] == "p" or name == stack[-1][0]):
            pop()  # a paragraph or item that was left open ends here
        if name == "a":
            link = True
        elif name in CONTAINERS:
            link = False
        named = name not in ("html", "body", "head") and _boilerplate(name, m[3], articles > 0)
        if name not in VOID and (named or name in CONTAINERS):
            stack.append((name, named))
            held[name] += 1
            bad += named
            articles += name in ("article", "main")
        yield name, False, "", bad > 0, link


def _feature(name: str) -> int:
    return _TAG_AT.get(name, _OTHER)


def _marked(page: str) -> str:
    """The element that marks the page's article, or nothing."""
    for name in ("article", "main"):
        opened = len(re.findall(rf"<{name}(?=[\s/>])", page, re.I))
        if opened == 1 and re.search(rf"</{name}\s*>", page, re.I):
            return name
        if opened:
            return ""
    return ""


def counted(page: str) -> Counter[tuple[int, bool]]:
    """How often each feature stands inside and outside the marked article of a labelled page; nothing for other pages."""
    found: Counter[tuple[int, bool]] = Counter()
    mark = _marked(page)
    if not mark:
        return found
    inside = False
    for name, closing, text, bad, link in tokens(page):
        if name == mark:
            inside = not closing
        elif name:
            found[_feature(name), inside] += 1
        elif not bad:
            found[LINK_WORD if link else WORD, inside] += len(text.split())
    return found


def weights(counts: dict[tuple[int, bool], int]) -> list[float]:
    """Log-ratio of a feature's share inside to its share outside; words stay positive and tags negative."""
    out = []
    for k in range(FEATURES):
        within, without = counts.get((k, True), 0), counts.get((k, False), 0)
        word = k in (WORD, LINK_WORD)
        value = math.log((within + (PRIOR if word else 1.0)) / (without + (1.0 if word else PRIOR / 4)))
        low, high = WORD_RANGE if k == WORD else LINK_RANGE if k == LINK_WORD else TAG_RANGE
        out.append(round(min(max(value, low), high) * 1024) / 1024)  # sums of such numbers are exact
    return out


def fitted(pages: DataFrame, html_col: str = "html") -> list[float]:
    """Weights from all labelled pages; ``2 * FEATURES`` sums at most reach the driver."""
    small_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[int, bool]] = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(counted(page or ""))
            give_back()
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[x] for x in keys], pa.int64())], names=["feature", "inside", "n"])

    rows = pages.select(html_col).mapInArrow(count, "feature int, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r.feature, r.inside): r.n for r in rows})


def main_text(page: str | None, weight: list[float]) -> str:
    """The text of the page's best region: one scan that remembers where the best sum so far began and ended."""
    score = best = 0.0
    begin = first = last = -1
    seen: list[tuple[str, str]] = []  # what a region's text is made of: ("", text) or (separator, "")
    for name, _, text, bad, link in tokens(page or ""):
        if name:
            score += weight[_feature(name)]
            if name in BLOCKS:
                seen.append(("\n", ""))
            elif name in SPACES:
                seen.append((" ", ""))
            continue
        if bad:
            continue
        text = html.unescape(text)
        n = len(text.split())
        seen.append(("", text))
        if not n:
            continue
        if score < 0 or begin < 0:
            score, begin = 0.0, len(seen) - 1
        score += n * weight[LINK_WORD if link else WORD]
        if score > best:
            best, first, last = score, begin, len(seen) - 1
    if first < 0:
        return ""
    blocks: list[list[str]] = [[]]
    for separator, text in seen[first : last + 1]:
        if separator == "\n":
            blocks.append([])
        else:
            blocks[-1].append(text or separator)
    texts = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n\n".join(t for t in texts if t)


def extracted(pages: DataFrame, weight: list[float], html_col: str = "html", *kept: str | Column) -> DataFrame:
    """The columns ``kept`` of every page with its main ``text`` and ``n_chars``."""
    small_batches(pages.sparkSession)
    own = pages.select(*kept, F.col(html_col).alias("__html"))
    out = own.drop("__html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page, weight) for page in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names)
            give_back()

    return own.mapInArrow(scan, out)


def report(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page, with weights from the labelled ones among them."""
    return extracted(pages, fitted(pages), "html", "page_id", "url")
