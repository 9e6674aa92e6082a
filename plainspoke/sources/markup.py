"""Pages read by tokens and a stack of open elements, in time linear in a page's length.

Tokens are texts, tags with quoted attributes (a ``>`` within quotes is no end),
comments, declarations and raw elements, whose content is no markup. Start tags close
what they imply to be over (a paragraph before a block, an item before an item),
void elements have no content, an end tag closes all that was opened since its
start, and one that fits nothing is left out.
Every piece of text belongs to the innermost block around it, so nested lists
give each item once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the markup language: elements without content, with raw content, and what a start tag closes within which bounds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose text is no part of a page's prose, elements that make a block of text, and elements that begin and end a line.
DROPPED = frozenset("script style noscript nav footer header form iframe svg button select aside menu textarea title".split())
OWN = frozenset(("p", "blockquote", "li"))
LINES = BLOCKS | {"li", "tr", "br", "dt", "dd"}
_NAME, _QUOTE = re.compile(r"[A-Za-z][^\s/>]*"), re.compile(r"[>\"']")
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close; names in lower case."""
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last[">"]:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        shut = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + shut)
        if not name:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = name.end()
        while (mark := _QUOTE.search(page, end)) and mark[0] != ">":  # a quote without a partner is an ordinary character
            end = mark.end() if mark.start() >= last[mark[0]] else page.find(mark[0], mark.end()) + 1
        if not mark:  # no end: what looks like a tag is text
            yield "text", page[lt:], ""
            return
        low, attributes, at = name[0].lower(), page[name.end() : mark.start()], mark.end()
        yield "close" if shut else "open", low, attributes
        if not shut and low in RAW and not attributes.endswith("/"):
            found = RAW[low].search(page, at)
            yield "text", page[at : found.start() if found else size], ""
            at = found.start() if found else size


def _squeezed(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class Page:
    """blocks: texts of paragraphs, quotes and items in order of their ends; article: lines of the first article, else main; links: (href, label)."""

    def __init__(self, page: str):
        self.blocks: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.own: list[list[str]] = []
        self.link: tuple[str, list[str]] | None = None
        self.areas: dict[str, list[str]] = {"article": [], "main": []}
        self.done: set[str] = set()
        self.dropped = 0
        for kind, name, more in tokens(page):
            if kind == "text":
                self._text(name)
            elif kind == "close":
                self._end(name)
            else:
                self._start(name, more)
        self._pop(len(self.stack))
        self._linked()
        area = next((self.areas[a] for a in ("article", "main") if self.areas[a]), [])
        self.article = "\n".join(x for x in (" ".join(line.split()) for line in "".join(area).split("\0")) if x)

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw).replace("\0", " ")
        if self.link:
            self.link[1].append(text)
        if self.dropped:
            return
        if self.own:
            self.own[-1].append(text)
        self._area(text)

    def _area(self, text: str) -> None:
        for name, parts in self.areas.items():
            if self.open[name] and name not in self.done:
                parts.append(text)

    def _start(self, name: str, more: str) -> None:
        if name in BLOCKS and self.open["p"]:
            self._shut({"p"}, {"button", "table", "td", "th", "caption"})
        if name in CLOSES:
            self._shut(*CLOSES[name])
        if name in LINES and not self.dropped:
            self._area("\0")
        if name in VOID:
            if self.own and not self.dropped:
                self.own[-1].append(" ")
            return
        if name == "a":
            self._linked()
            got = _HREF.search(more)
            self.link = (entities.unescape(next((g for g in got.groups() if g is not None), "")).strip(), []) if got else None
        self.stack.append(name)
        self.open[name] += 1
        self.dropped += name in DROPPED
        if name in OWN:
            self.own.append([])

    def _end(self, name: str) -> None:
        if name == "a":
            self._linked()
        if self.open[name]:
            depth = 1
            while self.stack[-depth] != name:
                depth += 1
            self._pop(depth)

    def _shut(self, names: set[str], bounds: set[str]) -> None:
        """Closes the innermost of ``names`` that is open within ``bounds``."""
        if any(self.open[n] for n in names):
            for depth, name in enumerate(reversed(self.stack), 1):
                if name in names:
                    self._pop(depth)
                    return
                if name in bounds:
                    return

    def _pop(self, depth: int) -> None:
        for _ in range(depth):
            name = self.stack.pop()
            if name in LINES and not self.dropped:
                self._area("\0")
            self.open[name] -= 1
            self.dropped -= name in DROPPED
            if name in self.areas and not self.open[name] and not self.dropped:
                self.done.add(name)
            if name in OWN:
                text = _squeezed(self.own.pop())
                if text and not self.dropped:
                    self.blocks.append(text)

    def _linked(self) -> None:
        if self.link:
            self.links.append((self.link[0], _squeezed(self.link[1])))
        self.link = None


def parsed(page: Column) -> Column:
    """Struct (blocks, article, links) of a column of pages; null pages are empty."""

    @F.pandas_udf("blocks array<string>, article string, links array<struct<href:string,label:string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            own = [Page(p if isinstance(p, str) else "") for p in pages]
            yield pd.DataFrame({"blocks": [p.blocks for p in own], "article": [p.article for p in own], "links": [[{"href": a, "label": b} for a, b in p.links] for p in own]})

    return read(page)
