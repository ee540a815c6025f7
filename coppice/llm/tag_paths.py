"""Main-text extraction by tag-path ratios.

A page's text falls into lines, one per run of text inside of a block element; inline
markup belongs to its block. Every line belongs to a root-to-leaf tag path (names of
the block elements and those around them, with their classes). Per page and path, text
length and punctuation are aggregated and divided by the path's number of lines. Both
ratios are smoothed along the page with a Gaussian window and fused by their product.
The fused ratio is multiplied by the share of the path's text that is no link, and by
the share of the page's plain text and punctuation that stands under the path's parent. Paths whose ratio reaches a threshold, a share of the page's mean weighted by
length, are content, wherever they stand.

Names only lower ratios: a path through an element that names itself boilerplate
(navigation, adverts, comments and the like) counts ``PRIOR`` of its length and of its
punctuation. Inside an article only whole parts (``PARTS``) can name themselves; what
a paragraph, a pull quote or a label is called says nothing there.

Short lines have low ratios and may still be text: of an article that has content, or
``HELD`` of the page's plain text, all lines are kept that are not in such a part; elsewhere headings, paragraphs, list items,
cells and captions are that stand beside content (under the same element, lists and
tables looked through) and are not mostly links.

An empty or null page has an empty text, and so has a page all of whose text is in
named parts. Paths of equal ratios are kept or go together. Pages are independent of
each other, so repeated rows and empty tables need nothing special. A page may be of
any length: the time is proportional to it. Extra columns are kept, whatever their
names; one that is called like a column of the result gives way.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_tree
from .common import guarded

# fixed values: elements of what is not the article, and of what is no prose
BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog head label input fieldset select option svg".split())
#: Words of a class, id or role that say so wherever they stand in it ("site-footer", "userComments") ...
STRONG_WORDS = frozenset(
    "advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter pager pagination popup promo promoted promotion respond sidebar sidenav signup sponsored subscribe subscription toolbar topbar".split()
)
#: ... and words that do so alone or with neutral ones ("share-buttons", but not "share-price").
WEAK_WORDS = frozenset("ad ads adv banner consent header notice notices notification related replies reply search share sharing skip social sponsor toc widget".split())
NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons container content form group icon icons inner item items left link links list main module outer page panel post right row section site slot small title top unit user wrap wrapper".split())
#: Elements around the whole page, whose classes say nothing about their text; what an article's class may say; what can hold an article.
OUTER_TAGS = frozenset(("html", "body", "main", ""))
NO_ARTICLE_WORDS = frozenset("ad ads advert comment comments promo promoted related replies reply respond sponsored teaser".split())
#: Elements that can name themselves inside an article.
PARTS = frozenset("article button dialog div fieldset footer form input nav option section select svg table ul ol".split())
#: Short lines that are kept beside content, and the elements that are looked through to find what they stand in.
SHORT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption blockquote pre summary address".split())
THROUGH = frozenset("ul ol dl li dd table tbody thead tfoot tr td th figure blockquote hgroup details".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？،؟।]")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PRIOR = 0.05
#: Width of the smoothing along the page, in lines: ratios of a short line bleed little into what is beside it.
WIDTH = 0.5
#: Share of link text from which a short line is no text.
LINKS = 0.5
#: Share of the page's plain text, boilerplate by name left aside, from which an article has content whatever its ratios are.
HELD = 0.3


def names_boilerplate(element: html_tree.Element) -> bool:
    """Whether an element names itself, whatever is around it."""
    name, attrs = element.name, element.attrs
    if name in BOILERPLATE_TAGS:
        return True
    if not attrs or name in OUTER_TAGS:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split():
        words = {w.lower() for w in WORDS.findall(token)}
        if name == "article":
            if words & NO_ARTICLE_WORDS:
                return True
        elif words & STRONG_WORDS or (words & WEAK_WORDS and words <= WEAK_WORDS | NEUTRAL_WORDS):
            return True
    return False


def smoothed(values: list[float], width: float = 1.0) -> list[float]:
    """Gaussian smoothing over neighbours, renormalised at the ends."""
    reach = max(1, math.ceil(2 * width))
    kernel = [math.exp(-(k * k) / (2 * width * width)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= k < len(values):
                total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def fused_ratios(nodes: list[tuple[int, str, float]], width: float = 1.0) -> dict[int, float]:
    """Each path's fused ratio; ``nodes``: (path, text, prior) of the lines, in page order."""
    length, points, count = (defaultdict(int) for _ in range(3))
    for path, text, _ in nodes:
        length[path] += len(text)
        points[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    text_ratio = smoothed([prior * length[path] / count[path] for path, _, prior in nodes], width)
    point_ratio = smoothed([prior * points[path] / count[path] for path, _, prior in nodes], width)
    out: dict[int, float] = defaultdict(float)
    for (path, _, prior), a, b in zip(nodes, text_ratio, point_ratio, strict=True):
        out[path] += prior * a * (1.0 + b) / count[path]
    return out


@dataclass
class Line:
    """A run of text inside of one block element; ``named`` if it lies in what names itself boilerplate, ``links`` of its characters in links."""

    block: html_tree.Element
    named: bool
    article: html_tree.Element | None
    parts: list[str]
    links: int = 0
    text: str = ""  # white space within is one space each

    @property
    def path(self) -> int:
        return 2 * self.block.path + self.named

    @property
    def parent(self) -> int:
        return self.block.parent.path if self.block.parent else 0

    @property
    def seat(self) -> html_tree.Element:
        """What the line stands in, lists and tables looked through."""
        at = self.block.parent or self.block
        while at.parent is not None and (at.name in THROUGH or at.block is not at):
            at = at.parent
        return at


def lines_of(page: str, names: bool = True) -> list[Line]:
    """The lines of a page that are not white space, in page order; without ``names`` none is named."""
    reader = html_tree.Reader()
    found = [(element, block, value) for kind, element, block, value in reader.nodes(page) if kind == "text"]
    named: dict[html_tree.Element, bool] = {}
    linked: dict[html_tree.Element, bool] = {}
    article: dict[html_tree.Element, html_tree.Element | None] = {}
    inner: dict[html_tree.Element, bool] = {}  # inside an article or main
    for e in reader.elements:  # parents come first
        up = e.parent
        within = up is not None and inner[up]
        own = (e.name == "header" and not within) or names_boilerplate(e)
        if up is not None and article[up] is not None and e.name not in PARTS:
            own = "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true"
        named[e] = names and ((up is not None and named[up]) or own)
        linked[e] = e.name == "a" or (up is not None and linked[up])
        article[e] = e if e.name == "article" else article[up] if up is not None else None
        inner[e] = within or e.name in ("article", "main")
    out: list[Line] = []
    last = None
    for e, block, value in found:
        if last != (block, named[e]):
            out.append(Line(e.block or reader.root, named[e], article[e], []))
            last = (block, named[e])
        out[-1].parts.append(value)
        out[-1].links += len(value.strip()) if linked[e] else 0
    for line in out:
        line.text = SPACE.sub(" ", "".join(line.parts))
    return out


def path_ratios(lines: list[Line]) -> tuple[dict[int, float], dict[int, float]]:
    """Each path's fused ratio times its share of plain text and its parent's share of the page; and its share of link text."""
    length, links = defaultdict(int), defaultdict(int)
    under: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])  # plain text and punctuation by parent
    for x in lines:
        n, prior = len(x.text.strip()), PRIOR if x.named else 1.0
        length[x.path] += n
        links[x.path] += x.links
        under[x.parent][0] += prior * max(0, n - x.links)
        under[x.parent][1] += prior * len(PUNCTUATION.findall(x.text))
    fused = fused_ratios([(x.path, x.text.strip(), PRIOR if x.named else 1.0) for x in lines], WIDTH)
    total = [sum(x[k] for x in under.values()) or 1.0 for k in (0, 1)]
    share = {p: (a / total[0] + b / total[1]) / 2 for p, (a, b) in under.items()}
    link_share = {p: min(1.0, links[p] / n) for p, n in length.items()}
    parent = {x.path: x.parent for x in lines}
    return {p: r * (1.0 - link_share[p]) * share[parent[p]] for p, r in fused.items()}, link_share


def main_text(page: str | None, share: float = 0.75, names: bool = True) -> str:
    """The page's main text; ``share`` of the mean ratio (weighted by length) is the threshold. Without ``names`` ratios decide alone."""
    lines = lines_of(page or "", names)
    some = [x for x in lines if x.text.strip()]
    if all(x.named for x in some):
        return ""
    ratio, links = path_ratios(some)
    weight = {p: (1.0 - links[p]) * (PRIOR if p % 2 else 1.0) for p in ratio}
    total = sum(len(x.text) * weight[x.path] for x in some)
    threshold = share * sum(ratio[x.path] * len(x.text) * weight[x.path] for x in some) / total if total else 0.0
    content = {p for p, r in ratio.items() if r >= threshold}
    plain: dict[html_tree.Element | None, int] = defaultdict(int)
    for x in some:
        plain[x.article] += 0 if x.named else max(0, len(x.text.strip()) - x.links)
    least = HELD * sum(plain.values())
    articles = {x.article for x in some if not x.named and (x.path in content or plain[x.article] >= least)} - {None}
    seats = {x.seat for x in some if x.path in content and not x.named}

    def kept(x: Line) -> bool:
        if x.path in content:
            return True
        if x.named:
            return False
        return x.article in articles or (x.block.name in SHORT and links[x.path] < LINKS and x.seat in seats)

    return "\n\n".join(x.text.strip() for x in some if kept(x))


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without ``html`` plus the main text and ``n_chars``; a clashing column of that name gives way."""
    return guarded(pages, (html,), lambda d: _extracted(d, html, into))


def _extracted(pages: DataFrame, html: str, into: str) -> DataFrame:
    keep = [c for c in pages.columns if c != html]
    schema = pages.select(*keep, F.lit("").alias(into), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [main_text(x) for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, into, "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)
