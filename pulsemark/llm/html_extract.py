"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block-level tags; nesting is kept only as flags. Each block has its word count and
link density, those of the blocks before and after it, and the kind of region it stands in. A decision tree trained on
the small labelled table below says which blocks belong to the article: the region is one feature of nine, and long link
lists inside an article or long texts under a doubtful name are told by words and links. An article that stands only
inside wrappers closed by a class, an id or a form is found by a second look at the page. Kept blocks are joined in page order.

One pass over each page, no shuffle; the tree holds a few dozen numbers and travels with the tasks.

Rules of text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one newline, empty blocks are dropped. A tag that breaks off at the page's end is markup, not text.

Edge cases: a null or blank html has an empty text; repeated rows give equal rows; unknown tags are inline; an
unclosed script or style runs to the end of the page; other columns are ignored and rows are kept one to one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.boosting import Tree
from pulsemark.llm.common import sliced

# fixed values: element classes
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video textarea select datalist title head".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript template".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button search fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar side rail menu menubar nav navbar"
    " navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments respond reply replies disqus discussion"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended recommendations widget widgets copyright pagination pager tags skip paywall survey disclaimer legal privacy terms".split()
)
BOILER_STEMS = ("adbox", "adslot", "adunit", "advert", "banner", "breadcrumb", "comment", "cookie", "disqus", "footer", "navbar", "navigation", "newsletter", "popup", "promo", "sidebar", "sponsor")
STATES = ("has", "with", "without", "no", "is")  # "has-sidebar" tells of another element
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
ARTICLE_WORDS = frozenset("article articlebody articletext content maincontent main post postbody postcontent pagecontent entry entrycontent story storybody body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_WORD = re.compile(r"[A-Za-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# words that also name parts of an article or its subject: they mark a region, and the tree decides
WEAK_WORDS = frozenset(
    "social share sharing related recommended recommendations legal privacy terms disclaimer notice notices alert alerts survey side rail foot"
    " tags skip widget widgets discussion signup subscription promo promotion".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

OUTSIDE, ARTICLE, BOILER, SKIPPED, WRAPPED, FORM, FLAGGED, PART = range(8)


def _named(attributes: str) -> Iterator[tuple[str, str]]:
    for m in _ATTR.finditer(attributes):
        yield m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""


def region_of(tag: str, attributes: str, above: int, reopen: bool = False) -> int:
    """Region an element opens, given the one around it.

    WRAPPED and FORM are closed by a class, an id or a form only: with ``reopen``, an article or main element, or inside a
    form a block named like an article, opens the article there. FLAGGED, or PART within an article, carries a weak word.
    """
    if above in (SKIPPED, BOILER):
        return SKIPPED if tag in SKIPPED_TAGS else above
    if tag in SKIPPED_TAGS:
        return SKIPPED
    closed = above in (WRAPPED, FORM)
    if closed and not reopen:
        return above
    inside = above in (ARTICLE, PART)
    if tag in BOILER_TAGS and tag != "form":
        return BOILER
    if tag == "header" and not inside:
        return BOILER
    region = ARTICLE if tag in ARTICLE_TAGS else FORM if tag == "form" else above
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in _named(attributes):
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return SKIPPED
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return SKIPPED
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    return BOILER
                if value.lower() in ("main", "article"):
                    region = ARTICLE
            elif tag not in ("body", "html") and not (name == "id" and tag in HEADINGS):
                split = [[w.lower() for w in _WORD.findall(_CAMEL.sub(" ", part))] for part in value.split()]
                words = {w for part in split if part and part[0] not in STATES for w in part}
                whole = {"".join(_WORD.findall(part)).lower() for part in value.split()}
                # "article-header" and the like inside an article are its own parts
                bad = {w for w in words if w in BOILER_WORDS or w.startswith(BOILER_STEMS)}
                if inside or tag in ARTICLE_TAGS:
                    bad -= {"header", "side", "text", "tags"} if words & ARTICLE_WORDS or inside else set()
                if bad - WEAK_WORDS and (tag not in ARTICLE_TAGS or closed):
                    return above if closed else WRAPPED
                if bad and tag not in ARTICLE_TAGS and not closed:
                    region = PART if inside else FLAGGED
                elif whole & ARTICLE_WORDS and tag in ("div", "section", "td") and above != WRAPPED:
                    region = ARTICLE
    return FLAGGED if region == ARTICLE and above == FLAGGED and not reopen else region


def blocks(page: str, reopen: bool = False) -> list[tuple[str, int, int, int, str]]:
    """(text, words, words inside links, region, tag) of every non-empty text block in page order."""
    out: list[tuple[str, int, int, int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    region, links, holder = OUTSIDE, 0, ""
    at, end = 0, len(page)

    def close():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, len(text.split()), len("".join(linked).split()), region, holder))
            parts.clear()
            linked.clear()

    def say(piece: str):
        if piece and region != SKIPPED:
            piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked.append(piece)

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(1) or m.group(4))
        attributes = m.group(3) or m.group(6) or ""
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
            close()
        if closing:
            if any(t == tag for t, _ in stack):
                while stack:
                    name, _ = stack.pop()
                    if name == "a":
                        links = max(0, links - 1)
                    if name == tag:
                        break
                now = stack[-1][1] if stack else OUTSIDE
                if now != region:
                    close()
                region = now
                holder = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "")
            continue
        if tag in VOID_TAGS:
            continue
        if tag == "p" or tag in BLOCK_TAGS and tag != "p":
            # an open paragraph ends where a block begins
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p":
                    links = max(0, links - sum(t == "a" for t, _ in stack[k:]))
                    del stack[k:]
                    region = stack[-1][1] if stack else OUTSIDE
                    break
                if name in BLOCK_TAGS:
                    break
        opened = region_of(tag, attributes, region, reopen)
        if opened != region:
            close()
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if attributes.endswith("/") and tag not in BLOCK_TAGS and tag not in ("a", "b", "i", "span"):
            continue
        stack.append((tag, opened))
        region = opened
        if tag == "a":
            links += 1
        if tag in BLOCK_TAGS:
            holder = tag
    close()
    return out


_PLACES = {ARTICLE: 2.0, PART: 1.5, OUTSIDE: 1.0, FLAGGED: 0.5}
_PROSE = ("p", "blockquote", "pre", "dd", "figcaption", "td")


def describe(found: list[tuple[str, int, int, int, str]], has_article: bool) -> list[list[float]]:
    """Features of each block: words, link density, those of its neighbours, region, kind of tag."""
    size = [float(min(w, 400)) for _, w, _, _, _ in found]
    dense = [k / w for _, w, k, _, _ in found]
    out = []
    for i, (_, _, _, region, tag) in enumerate(found):
        prev, after = (size[i - 1], dense[i - 1]) if i else (0.0, 0.0), (size[i + 1], dense[i + 1]) if i + 1 < len(found) else (0.0, 0.0)
        place = _PLACES.get(region, 0.0)
        out.append([size[i], dense[i], *prev, *after, place, float(has_article), 2.0 if tag in HEADINGS else 1.0 if tag in _PROSE else 0.0])
    return out


# the labelled table: words, link density, before, after (words, density), place, page has an article, tag, keep
LABELLED = """
6 1.0 0 0.0 6 1.0 0 1 0 0 | 1 1.0 1 1.0 1 1.0 0 1 0 0 | 12 0.0 1 1.0 8 0.0 0 1 0 0 | 90 0.0 20 0.0 30 0.0 0 1 1 0 | 40 0.0 80 0.0 0 0.0 0 1 1 0
3 0.0 60 0.0 2 1.0 0 1 2 0 | 25 0.1 60 0.0 0 0.0 0 1 0 0 | 150 0.0 150 0.0 90 0.0 0 1 1 0 | 1 1.0 0 0.0 1 1.0 0 0 0 0 | 30 0.0 1 1.0 60 0.0 0 0 1 0
200 0.0 40 0.0 40 0.0 0 0 1 0 | 5 0.0 0 0.0 70 0.0 0 0 2 0 | 20 0.3 50 0.0 0 0.0 0 0 0 0 | 8 0.5 8 0.5 8 0.5 0 0 0 0 | 60 0.0 2 1.0 70 0.0 0 0 0 0
7 0.0 12 0.0 60 0.0 2 1 2 1 | 2 0.0 40 0.0 60 0.0 2 1 2 1 | 1 0.0 30 0.0 30 0.0 2 1 1 1 | 60 0.0 7 0.0 45 0.0 2 1 1 1 | 30 0.2 60 0.0 20 0.0 2 1 1 1
5 0.0 40 0.0 12 0.0 2 1 1 1 | 90 0.1 30 0.0 3 0.0 2 1 1 1 | 12 0.0 30 0.0 11 0.0 2 1 0 1 | 9 0.4 12 0.0 10 0.0 2 1 0 1 | 4 1.0 50 0.0 60 0.0 2 1 2 1
25 0.0 8 0.0 20 0.5 2 1 0 1 | 3 0.0 9 0.0 12 0.0 2 1 0 1 | 10 1.0 30 0.0 40 0.0 2 1 1 1 | 1 0.0 0 0.0 0 0.0 2 1 1 1 | 300 0.0 0 0.0 0 0.0 2 1 0 1
8 0.9 30 0.0 8 1.0 2 1 0 0 | 4 1.0 5 1.0 4 1.0 2 1 0 0 | 6 1.0 8 1.0 7 1.0 2 1 0 0 | 3 1.0 60 0.0 3 1.0 2 1 0 0 | 5 0.9 3 0.9 5 0.1 2 1 0 0
50 0.0 8 0.0 3 1.0 1 1 0 0 | 8 0.0 3 1.0 60 0.0 1 1 1 0 | 3 1.0 50 0.0 0 0.0 1 1 0 0 | 30 0.0 1 1.0 9 0.0 1 1 1 0 | 14 0.0 70 0.0 2 0.0 1 1 2 0
120 0.0 30 0.0 8 0.5 1 1 1 0 | 2 0.0 9 1.0 80 0.0 1 1 2 0 | 70 0.0 60 0.0 50 0.0 1 1 1 0 | 6 0.5 70 0.0 1 0.0 1 1 0 0 | 40 0.1 40 0.0 2 1.0 1 1 0 0
80 0.0 60 0.0 45 0.0 1 0 1 1 | 45 0.1 80 0.0 20 0.0 1 0 1 1 | 25 0.0 70 0.0 60 0.0 1 0 1 1 | 12 0.0 60 0.0 60 0.0 1 0 1 1 | 6 0.0 60 0.0 60 0.0 1 0 1 1
7 0.0 3 1.0 60 0.0 1 0 2 1 | 4 0.0 50 0.0 70 0.0 1 0 2 1 | 200 0.0 10 0.5 10 0.5 1 0 0 1 | 40 0.0 5 0.0 30 0.0 1 0 0 1 | 30 0.0 40 0.0 2 1.0 1 0 1 1
18 0.0 5 0.0 0 0.0 1 0 1 1 | 15 0.1 3 0.9 20 0.0 1 0 1 1 | 9 0.0 30 0.0 12 0.0 1 0 0 1 | 30 0.0 0 0.0 0 0.0 1 0 0 1 | 8 0.0 0 0.0 0 0.0 1 0 1 1
3 1.0 3 1.0 3 1.0 1 0 0 0 | 8 1.0 60 0.0 8 1.0 1 0 0 0 | 2 0.0 3 1.0 3 1.0 1 0 0 0 | 1 0.0 2 1.0 1 0.0 1 0 0 0 | 20 0.8 20 0.9 20 0.8 1 0 1 0
60 0.0 1 1.0 40 0.0 0.5 1 1 0 | 8 0.5 30 0.0 5 1.0 0.5 1 0 0 | 120 0.0 80 0.0 60 0.0 0.5 1 1 0 | 3 0.0 60 0.0 4 1.0 0.5 1 2 0 | 30 0.0 4 1.0 60 0.0 0.5 1 0 0
80 0.0 60 0.0 70 0.0 0.5 0 1 1 | 60 0.05 7 0.0 80 0.0 0.5 0 1 1 | 200 0.0 5 0.0 40 0.0 0.5 0 0 1 | 40 0.0 80 0.0 3 1.0 0.5 0 1 1 | 4 0.0 0 0.0 70 0.0 0.5 0 2 1 | 1 0.0 0 0.0 90 0.0 0.5 0 2 1
4 1.0 4 1.0 4 1.0 0.5 0 0 0 | 9 0.4 3 1.0 3 1.0 0.5 0 0 0 | 14 0.2 0 0.0 60 0.0 0.5 0 1 0 | 2 0.0 80 0.0 1 1.0 0.5 0 0 0 | 20 0.9 3 0.0 40 0.0 0.5 0 1 0
70 0.0 60 0.0 40 0.0 1.5 1 1 1 | 45 0.1 5 0.0 80 0.0 1.5 1 1 1 | 3 0.0 50 0.0 45 0.0 1.5 1 2 1 | 25 0.0 3 0.0 30 0.0 1.5 1 1 1 | 90 0.0 40 0.0 0 0.0 1.5 1 0 1
1 1.0 60 0.0 1 1.0 1.5 1 0 0 | 2 0.0 60 0.0 1 1.0 1.5 1 0 0 | 4 1.0 1 1.0 30 0.0 1.5 1 0 0 | 7 0.9 60 0.0 0 0.0 1.5 1 1 0 | 3 0.7 3 1.0 3 1.0 1.5 1 0 0
50 0.0 100 0.0 14 0.0 2 1 1 1 | 2 0.0 2 0.0 2 0.0 2 1 1 1 | 120 0.0 0 0.0 0 0.0 2 1 1 1 | 2 0.0 0 0.0 80 0.0 2 1 2 1 | 80 0.0 2 0.0 0 0.0 2 1 1 1
60 0.0 2 1.0 5 1.0 2 1 1 1 | 60 0.0 2 1.0 60 0.0 2 1 1 1 | 60 0.0 60 0.0 5 1.0 2 1 1 1 | 25 0.0 2 1.0 30 0.0 2 1 1 1 | 5 1.0 60 0.0 5 1.0 2 1 0 0 | 2 0.0 60 0.0 0 0.0 1 0 1 1
5 1.0 0 0.0 60 0.0 1 0 1 0 | 4 0.0 2 1.0 2 0.0 1 0 0 0 | 12 0.7 50 0.0 0 0.0 1 0 0 0 | 9 0.6 9 0.6 70 0.0 1 0 1 0 | 2 1.0 4 0.0 3 1.0 1 0 2 0
"""


def labelled() -> np.ndarray:
    """The labelled table: eight features of a block, the kind of its tag, and whether it belongs to the article."""
    return np.array([[float(v) for v in cell.split()] for line in LABELLED.strip().splitlines() for cell in line.split("|")])


@lru_cache(maxsize=1)
def trained() -> Tree:
    rows = labelled()
    return Tree(depth=10, min_rows=1).fit(rows[:, :-1], rows[:, -1])


def page_blocks(page: str) -> tuple[list[tuple[str, int, int, int, str]], bool]:
    """Blocks of a page, and whether it has an article; below wrappers it is looked for only where there is none beside."""
    for reopen in (False, True):
        found = blocks(page, reopen)
        if any(region in (ARTICLE, PART) for *_, region, _ in found):
            return found, True
    return found, False


def main_text(page: str | None, tree: Tree) -> str:
    if not page:
        return ""
    found, has_article = page_blocks(page)
    if not found:
        return ""
    kept = [b[0] for b, row in zip(found, describe(found, has_article)) if tree.value(row) >= 0.5]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(page.as_py(), tree) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
