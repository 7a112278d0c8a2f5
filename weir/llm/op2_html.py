"""HTML extraction: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page is split into blocks at block-level tags by a scanner that reads it once. A block's features are its words, its
link density, its share of stock phrases and those of the heading above it, how many linked blocks stand in a row, words
and link density of the blocks before and after it, and what it stands in (the element that names the main content, a
furniture element or one whose class or id names furniture, an article much smaller than the page's largest). A small
tree, grown by Gini impurity on the hand-labelled pages of LABELLED, decides. Pages are independent rows: no shuffle,
memory for one batch of pages at a time.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.session import bound_batches, table

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDS = _BLOCK - {"p", "hr", "li", "dt", "dd", "td", "th", "tr"} | {"button", "label"}
_FURNITURE_TAGS = frozenset("nav footer aside form header head menu dialog button fieldset".split())
#: Elements without text of the page: those of the first line swallow all up to their end tag (or the page's end), the others only if they have one.
_RAW = frozenset("script style".split())
_HIDDEN = frozenset("title textarea noscript template svg iframe object canvas select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ID = re.compile(r"""(?<![\w-])id\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A name is furniture if its last part is, parts that only say which or where left aside; one with a word of denial before it isn't.
_FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar tooltip widget widgets alert".split())
_WHICH = frozenset("area bar block body bottom box button buttons card cell col column container content first form group holder icon icons inner item items last left level link links list main outer panel primary right row secondary section slot small stories title top unit wrap wrapper".split())
_DENIAL = frozenset("no non not without has with hide hidden".split())
_MAIN = re.compile(r"(?<![a-z])(?:article(?:-?body)?|entry-content|main(?:-?content)?|post-?(?:body|content))(?![a-z-])", re.I)
#: Stock phrases: those of the first pattern ask the reader for something or announce other pages, those of the second may as well be an article's own words.
_STOCK = re.compile(r"(?<!\w)(?:sign up|subscribe|advertisements?|sponsored|share (?:this|on)|tweet|(?:related|recommended|popular|latest) (?:articles?|posts?|stories|links|news|reading)|you (?:may|might) also like|more (?:from|like|stories|articles|news|posts)|read (?:more|also|next)|leave a (?:comment|reply)|log in|sign in|follow us|skip to content|back to top|print this|most (?:popular|read)|our newsletter|accept (?:all )?cookies)(?!\w)", re.I)
_WEAK = re.compile(r"(?<!\w)(?:newsletter|cookies?|consent|comments?|reply|replies|privacy policy|terms of (?:use|service)|copyright|all rights reserved)(?!\w)|©", re.I)


def _is_furniture(name: str) -> bool:
    """Whether one class, id or role names page furniture."""
    parts = [x.lower() for x in _PART.findall(name[:200])]
    while len(parts) > 1 and (parts[-1] in _WHICH or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in _FURNITURE and not _DENIAL & set(parts[:-1])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, "") and (tag, attributes, "/" for an end tag) in page order. Every character is passed a bounded number of times, however broken the markup."""
    at, n, last = 0, len(page), page.rfind(">")
    quotes = {'"': True, "'": True}
    missing: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):  # no tag ends any more
            yield "", page[at:], ""
            return
        if lt > at:
            yield "", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt + 1)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?"):
                at = page.find(">", lt) + 1
            else:
                yield "", "<", ""
                at = lt + 1
            continue
        end = m.end()
        while True:
            end = _PLAIN.match(page, end).end()
            if end >= n:  # a quote swallowed the rest: from here on quotes are not looked at
                quotes = dict.fromkeys(quotes, False)
                end = page.find(">", m.end())
                break
            if page[end] == ">":
                break
            close = page.find(page[end], end + 1) if quotes[page[end]] else -1
            if close < 0:
                quotes[page[end]] = False
            end = max(close, end) + 1
        tag, close = m[1].lower(), "/" if page[lt + 1] == "/" else ""
        attrs, at = page[m.end() : end], end + 1
        if not close and (tag in _RAW or tag in _HIDDEN) and not attrs.endswith("/") and tag not in missing:
            stop = _closing(tag).search(page, at)
            if stop and stop.end() <= last:
                at = page.find(">", stop.end()) + 1
                continue
            missing.add(tag)
            if tag in _RAW:
                return
        yield tag, attrs, close


@functools.lru_cache(32)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class Block(NamedTuple):
    text: str
    place: int  #: 2 in the main element, 1 if the page has none, 0 outside it
    boxed: bool  #: in a furniture element or one whose name says so; in a main element only what is inside it counts
    article: int  #: which article element it stands in, 0 for none
    heading: bool
    words: int
    linked: int
    stock: int
    weak: int


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, in main, boxed, article
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    link = has_main = heading = False
    articles = 0

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, inside, boxed, article = stack[-1]
            stock, weak = (sum(len(x.split()) for x in p.findall(text)) for p in (_STOCK, _WEAK))
            out.append(Block(text, int(inside), boxed, article, heading, len(text.split()), len(html.unescape("".join(linked)).split()), stock, weak))
        parts.clear(), linked.clear()

    for tag, body, close in tokens(page):
        if not tag:
            parts.append(body)
            if link:
                linked.append(body)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = not close
        if tag in _BLOCK or tag in _HOLDS:
            end()
            link = False
            heading = tag in _HEADINGS and not close
        if tag in _HOLDS and tag not in _HEADINGS:
            if close:
                if open_[tag]:
                    while (top := stack.pop()[0]) != tag:
                        open_[top] -= 1
                    open_[tag] -= 1
            elif not body.endswith("/"):
                _, inside, boxed, article = stack[-1]
                # Sections of an article are named after their headings.
                found = [] if tag in ("html", "body") else _NAMED.findall(body if not (inside and tag == "section") else _ID.sub(" ", body))
                names = [x for f in found for y in f for x in y.split()]
                boxed = boxed or (tag in _FURNITURE_TAGS and not (inside and tag == "header")) or any(map(_is_furniture, names))
                if not boxed and (tag in ("article", "main") or any(map(_MAIN.search, names))):
                    has_main = inside = True
                if tag == "article":
                    articles += 1
                    article = articles
                stack.append((tag, inside, boxed, article))
                open_[tag] += 1
    end()
    return [b._replace(place=2 if b.place else 0 if has_main else 1) for b in out]


#: Pages labelled by hand, a page between blank lines: each block begins with + (main text) or -; {n} stands for n words, [n] for n linked ones.
LABELLED = """
<header>-{2} [2]</header><nav><ul><li>-[1]<li>-[1]<li>-[2]</ul></nav><main><h1>+{6}</h1><p>+{4} [1]</p><p>+{64} [2]</p><h2>+{3}</h2><p>+{120} [6]</p><blockquote>+{18}</blockquote><p>+[14]</p><p>+{38} [1]</p></main><footer>-{11} [3]</footer>

<a>-Skip to content</a><div class=cookie-banner>-{10} accept cookies</div><nav>-[1] [1] [2]</nav><main><p>+{90}</p><p>+{30}</p><p>+{55} [3]</p></main><footer><p>-{9}</p><p>-[8]</p></footer>

<div class=menu>-[1] [1] [1]</div><article><p>+{80} [2]</p><aside>-[7]</aside><p>+{60}</p><div class=ad>-[5]</div><p>+{45}</p><div class=ad>-{12}</div><p>+{70}</p><footer>-{2} [1]</footer></article><div class=comments><p>-{40}</p><p>-{15}</p></div>

<ol class=breadcrumb><li>-[1]<li>-[1]<li>-[3]</ol><article><h1>+{7}</h1><p>+{90}</p><form>-{12}</form><p>+{70} newsletter [3]</p><section class=related-stories>-[9]</section><p>+{55}</p><p>-Sign up for our newsletter!</p><h3>-Related articles</h3><ul><li>-[8]<li>-[6]<li>-[9]</ul></article><footer>-{12} [4]</footer>

<article><h1>+{5}</h1><p>+{50}</p><h2>+Cookies</h2><p>+{40} cookies {20}</p><h2>+Comments</h2><p>+Comments {4}</p><p>+{35} comments {5}</p><h2>+Reply</h2><p>+{30}</p><h2>+{2}</h2><ol><li>+[6]<li>+[9]<li>+{3} [5]<li>+[7]<li>+[4] {2}</ol></article>

<main><h1>+{4}</h1><p>+{40}</p><ul><li>+[3]<li>+[4]</ul><p>+{60}</p><p>+{20}</p><ul><li>+[2]<li>+[5]<li>+[3]</ul><p>+{30}</p><h2>-More from us</h2><ul><li>-[5]<li>-[7]<li>-[4]<li>-[6]</ul></main>

<main><h1>+{4}</h1><p>+{33}</p><ul><li>+{9}<li>+{12}<li>+[5] {6}</ul><p>+{41}</p><p>-Read more: [4]</p><p>-Share this [2]</p></main><div>-{40}</div><p>-[6]</p>

<article><h1>+{6}</h1><p>+{1}</p><p>+{2}</p><p>+{1}</p><p>+[4]</p><p>+{1}</p><p>+{12}</p><p>+{2}</p><p>+[1]</p><p>+{3}</p></article><footer>-{6}</footer>

<nav>-[4]</nav><article><h1>+{8}</h1><p>+{150} [20]</p><p>+{200} [10] cookies</p><p>+{10}</p><p>+{3} copyright {9}</p><p>+{6}</p></article><article><h3>-[6]</h3><p>-{14}</p></article><article><h3>-[4]</h3><p>-{9} [2]</p></article><p>-{31} [4] privacy policy</p>

<article><h2>+{5}</h2><p>+{80}</p><p>+{40}</p></article><article><h2>+{6}</h2><p>+{60}</p><p>+{50} [2]</p></article><article><h2>+[4]</h2><p>+{90}</p></article>

<ul><li>-[2]<li>-[1]<li>-[3]</ul><h1>+{8}</h1><p>+{45}</p><p>+{80} [4]</p><h2>+{4}</h2><p>+{60} [2]</p><p>+{3}</p><p>+{30} [1]</p><ul><li>-[5]<li>-[6]</ul><p>-Copyright {8} [1]</p>

<div><a>-[3]</a></div><div>-[1] [1] [1] [2]</div><h1>+{9}</h1><div>+{70} [1]</div><div>+{34}</div><h3>-Comments</h3><p>-{22}</p><p>-{9}</p><p>-{41}</p>

<header>-[5]</header><div class=topnav>-{2} [18]</div><p>+{16}</p><p>+{33} [3]</p><p>+{52}</p><h3>-Leave a comment</h3><p>-{12}</p><p>-[8]</p><p>-{6} all rights reserved</p><footer>-{8} [4]</footer>

<div>-{4}</div><ul><li>-[2]<li>-[6]<li>-[1]<li>-[2]</ul><p>-{12}</p><div>-[7]</div><p>-{3}</p><div>-[12]</div><p>-{2} [4] read more</p>

<p>+{25}</p><p>+{1}</p><p>+{35}</p><p>+{9}</p><p>+{28}</p><div class=sidebar>-{50}</div><aside>-{45}</aside><p>+{100} cookies {9}</p><p>-Subscribe to our newsletter {3}</p><p>-[8]</p>

<main><p>+{6}</p><p>+{40}</p><p>+{1}</p></main>

<article>+{9}</article>

<p>+{50}</p><p>+{20}</p><p>+{7}</p>

<p>+{3}</p>

<p>+{33} [2]</p><p>+{12}</p>

<main><p>+{30}</p><p>+{22} [1]</p></main>

<ul><li>-[1]<li>-[1]</ul><p>+{40}</p><p>+{3}</p><p>+{30}</p><ul><li>-[2]</ul>

<p>-[6]</p><p>+{50}</p><p>+{20} cookies {12} cookies, cookies {9}</p><p>+[5]</p><p>+{45} comments {2} cookies {20}</p><p>+{18} consent {4}</p><p>+{33}</p>

<p>+{50}</p><aside>-[5]</aside><p>+{40}</p><div class=ad>-[8]</div><p>+{60}</p><nav>-[3]</nav><p>+{30}</p>

<p>+{60}</p><p>+{2}</p><p>+{35}</p><p>-[3]</p>

<h1>+{4}</h1><p>+{2}</p><p>+{24}</p><div>-[2] [3]</div><div>-[2]</div>

<main><h1>+All rights reserved</h1><p>+{30}</p><p>+All rights reserved</p><p>+{40}</p><p>+{3} all rights reserved</p></main>

<div>-[3]</div><div>-[2]</div><p>+{16}</p><p>+{70} [4]</p><p>+[12]</p><p>+{48}</p><p>+{26}</p><p>-We use cookies {5}</p>

<p>-{8}</p><nav>-[30]</nav><main><h1>+{14}</h1><p>+[20]</p><p>+{25}</p><p>+[70]</p><p>+{27} [3]</p><button>-{3}</button></main><p>-{120} [10]</p><div class=totop>-Back to top</div>

<nav>-[3]</nav><article><h1>+{5}</h1><div class=share-buttons>-[3]</div><p>+{60}</p><h2>-You might also like</h2><p>-[9]</p><p>-[7]</p><h2>+{3}</h2><p>+{44}</p><p>+[11]</p><p>+{52}</p></article>

<div class=header>-{3}</div><div id=nav>-[2] [3]</div><h1>+{7}</h1><p>+{66}</p><ul><li>+{5}<li>+{8}<li>+{4} [1]</ul><p>+{40}</p><p>+[3]</p><p>+{38}</p><h4>-Most popular</h4><ul><li>-[4]<li>-[8]<li>-[5]</ul><div>-© {5}</div>
"""
_NONE = (0, 0.0)
_LINKED = 0.5


def features(found: list[Block]) -> list[tuple]:
    """A row for each block: place, boxed, words, link density, shares of stock phrases and weak ones, heading, those shares of the heading above, linked blocks in a row, before's and after's words and link density, words of its article by those of the largest."""
    density = [b.linked / b.words for b in found]
    row, rows = 0, []
    for d in density:
        row = row + 1 if d > _LINKED else 0
        rows.append(row)
    for i in range(len(rows) - 2, -1, -1):
        rows[i] = max(rows[i], rows[i + 1]) if rows[i] and rows[i + 1] else rows[i]
    held: Counter[int] = Counter()
    for b in found:
        held[b.article] += b.words * (not b.boxed)
    largest = max((n for a, n in held.items() if a), default=0)
    out, above = [], (0.0, 0.0)
    for i, b in enumerate(found):
        before, after = ((found[j].words, density[j]) if 0 <= j < len(found) else _NONE for j in (i - 1, i + 1))
        own = (b.stock / b.words, b.weak / b.words)
        if b.heading:
            above = (0.0, 0.0)
        share = held[b.article] / largest if b.article and largest else 1.0
        out.append((b.place, int(b.boxed), b.words, density[i], *own, int(b.heading), *above, rows[i], *before, *after, share))
        if b.heading:
            above = own
    return out


def _spelled(page: str, scale: float) -> str:
    """A labelled page as markup, with scale times the words of its longer blocks."""
    n = lambda m: int(m[1]) if int(m[1]) < 15 else max(15, round(scale * int(m[1])))
    page = re.sub(r"\{(\d+)\}", lambda m: "w " * n(m), page)
    return re.sub(r"\[(\d+)\]", lambda m: f"<a>{'w ' * n(m)}</a>", page)


def labelled_rows(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages' blocks, each page with shorter and longer paragraphs too."""
    x, y = [], []
    for page in text.strip().split("\n\n"):
        for scale in (0.6, 1.0, 2.5):
            marks: list[bool] = []
            found = []
            for b in blocks(_spelled(page, scale)):
                marks.append(b.text[0] == "+")
                text_, words = b.text[1:].strip(), len(b.text[1:].split())
                found.append(b._replace(text=text_, words=words, linked=min(b.linked, words)))
            x += features(found)
            y += marks
    return np.array(x, float), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | int:
    """(feature, threshold, tree at most, tree above) or a class."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (2 * share * (1 - share) - 1e-12, None)
    for j in range(x.shape[1]):
        levels = np.unique(x[:, j])
        for t in (levels[:-1] + levels[1:]) / 2:
            low = x[:, j] <= t
            a, b, p = y[low].mean(), y[~low].mean(), low.mean()
            impurity = 2 * p * a * (1 - a) + 2 * (1 - p) * b * (1 - b)
            if impurity < best[0]:
                best = (impurity, (j, float(t)))
    if best[1] is None:
        return int(share >= 0.5)
    j, t = best[1]
    low = x[:, j] <= t
    return (j, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@functools.lru_cache(1)
def tree() -> tuple | int:
    return grow(*labelled_rows())


def decide(node: tuple | int, row: tuple) -> int:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found)) if decide(tree(), row))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html): the main blocks in page order, joined by a line feed.

    A null or blank page, or one without main text, has an empty text; null ids and urls are kept, repeated rows
    are extracted each; other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
