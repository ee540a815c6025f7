"""A small forgiving HTML reader: text and media nodes in page order, each with its innermost open element.

It runs in time proportional to the page: elements know their parent, their
nearest block and the id of their tag path, and open elements are found by name
without walking up.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TOKEN = re.compile(
    r"""(?P<text>[^<]++)
    |<!--.*?(?:-->|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>
    |<[!?/][^>]*+>
    |<[a-zA-Z!?/][^<]*+\Z
    |(?P<stray><)""",
    re.S | re.X,
)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MEDIA = frozenset("img audio video source embed".split())
FOREIGN = frozenset(("svg", "math"))
#: What an opening element closes when it is open: up to the named barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class Element:
    """An open or closed element. ``path`` names its tag path: the same number for equal names and classes from the root."""

    __slots__ = ("attrs", "block", "depth", "name", "open", "parent", "path")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None, path: int):
        self.name, self.attrs, self.parent, self.path, self.open = name, attrs, parent, path, True
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if name in BLOCK else parent.block if parent else None

    def up(self) -> Iterator[Element]:
        """This element and those around it."""
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)}


class Reader:
    """Reads one page; ``root`` is around everything, ``elements`` lists all in the order of their start tags."""

    def __init__(self) -> None:
        self.root = Element("", {}, None, 0)
        self.elements = [self.root]
        self.now = self.root
        self.named: dict[str, list[Element]] = {}
        self.paths: dict[tuple, int] = {}

    def nearest(self, name: str) -> Element | None:
        """The innermost open element of a name."""
        stack = self.named.get(name, [])
        while stack and not stack[-1].open:
            stack.pop()
        return stack[-1] if stack else None

    def close(self, element: Element) -> None:
        while True:
            at, self.now = self.now, self.now.parent or self.root
            at.open = False
            if at is element:
                return

    def start(self, name: str, attrs: dict[str, str]) -> None:
        key = (self.now.path, name, " ".join(sorted(attrs["class"].split())) if attrs.get("class") else "")
        element = Element(name, attrs, self.now, self.paths.setdefault(key, len(self.paths) + 1))
        self.elements.append(element)
        self.named.setdefault(name, []).append(element)
        self.now = element

    def nodes(self, page: str) -> Iterator[tuple[str, Element, int, object]]:
        """Yields ("text", element, block, decoded text) and ("media", element, block, attributes).

        ``block`` changes wherever a block-level element starts or ends. Unclosed elements, stray ends and
        cut-off pages are taken as browsers do.
        """
        block, at, size = 0, 0, len(page)
        while at < size:
            m = TOKEN.match(page, at)
            at = m.end()
            if (text := m["text"] or m["stray"]) is not None:
                yield "text", self.now, block, html.unescape(text)
                continue
            name, end = m["name"] or m["name2"], m["end"] or m["end2"]
            if name is None:
                continue
            name = name.lower()
            if end:
                if name in BLOCK:
                    block += 1
                found = self.nearest(name)
                if found and (name in BLOCK or self.now.block is None or found.depth > self.now.block.depth):
                    self.close(found)
                continue
            raw = m["attrs"] or m["attrs2"] or ""
            attrs = attributes(raw)
            if name in BLOCK:
                block += 1
                if self.now.block is not None and self.now.block.name == "p":  # an open paragraph ends where a block begins
                    self.close(self.now.block)
            if name in CLOSES:
                closed, barrier = ([e for x in names if (e := self.nearest(x))] for names in CLOSES[name])
                deepest = max(closed, key=lambda e: e.depth, default=None)
                if deepest and all(e.depth < deepest.depth for e in barrier):
                    self.close(deepest)
            if name in MEDIA and (attrs.get("src") or attrs.get("data-src")):
                yield "media", self.now, block, attrs
            if name == "br":
                yield "text", self.now, block, " "
            elif name in RAW:
                close = CLOSE[name].search(page, at)
                at = close.end() if close else size
            elif name not in VOID and not (name in FOREIGN and raw.rstrip().endswith("/")):
                self.start(name, attrs)


def nodes(page: str) -> Iterator[tuple[str, Element, int, object]]:
    return Reader().nodes(page)
