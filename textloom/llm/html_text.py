"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page that has text. The text lengths of a sliding window of lines (a line-block) rise at
the surge point of the article and fall to nothing at its dive point; the text between is kept. This decides on every page.

Markup only gives features of lines. A line in an element that can't be article text (script, menu, header, footer, side bar, notice, advert, form, reader comment)
has the length 0 and no text, so such elements form the valleys between which the article stands out; so does the border of an element for the
main text. Text in links doesn't count as length. The element in which lines of a region that surges stand (for paragraphs, headings and list items the one around them) is the article's, and what such valleys
or links have cut off inside it is article text as well: titles, short and linked paragraphs, lists of links. In the body itself that holds for blocks with text of their own, and for all between
the first and the last that surge.

Time grows with the length of a page, however its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, quote_columns

#: Lines in a line-block, and the length from which a block is a surge.
WINDOW, SURGE = 3, 60

TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?][^>]*>)", re.S)
#: A tag whose quotes don't close: up to the next >.
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements by what they mean here.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
DROP = frozenset("nav header footer aside form button select menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Blocks of text: they stand in the element around them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote figure figcaption address hgroup center".split())
ROOT = frozenset(("", "html", "body"))
#: Names of classes and ids that mark what is not the article, and words that may stand beside one in a compound; with any other word, as in article-header, a name marks nothing.
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "comment comments disqus respond notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login search share sharing social related recommended "
    "pagination pager toolbar copyright skip".split())  # fmt: skip
BESIDE = frozenset(
    "a area bar bottom box block btn button by center container content cta top left right main fixed float floating full global group holder inner inline item items js large left link links list mobile "
    "module outer overlay page panel primary reader secondary section site slot small square sticky text the this unit us user wrap wrapper zone".split())  # fmt: skip
NAME = re.compile(r"[a-z]+")


def _marks(name: str) -> bool:
    words = NAME.findall(name)
    return any(w in DROP_NAMES for w in words) and all(w in DROP_NAMES or w in BESIDE for w in words)


def _dropped(name: str, attributes: str) -> bool:
    if name in DROP:
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in DROP_ROLES:
            return True
        if key in ("class", "id") and any(map(_marks, value.split())):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Page:
    """Lines of a page with, for each, how many of its characters are in links and the block element (a number) that it stands in; ``parents`` and ``names`` are those of the elements.

    A block of a dropped element is an empty line, and so are ``WINDOW`` lines at each border of an element for the main text; blocks without text are no lines.
    """

    def __init__(self, page: str):
        self.lines: list[str] = []
        self.links: list[int] = []
        self.nodes: list[int] = []
        self.parents, self.names = [0], [""]
        self._held: list[str] = []
        self._linked = self._dropping = self._anchors = 0
        self._dropped = False  # whether the block has text that is dropped
        # open elements (name, whether it drops, its number), None for an inline one that was closed inside others; and where those of each name, blocks and those that stray end tags don't leave stand
        self._open: list[tuple[str, bool, int] | None] = []
        self._by_name: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._mains: list[int] = []
        self._drops: list[int] = []
        self._read(page)

    def _text(self, raw: str) -> None:
        if self._dropping:
            self._dropped = self._dropped or not raw.isspace() and raw != ""
        elif raw:
            self._held.append(raw)
            if self._anchors:
                self._linked += len(raw)

    def _node(self) -> int:
        return self._open[self._blocks[-1]][2] if self._blocks else 0

    def _put(self, line: str, linked: int = 0) -> None:
        self.lines.append(line)
        self.links.append(linked)
        self.nodes.append(self._node())

    def _flush(self) -> None:
        line = " ".join(html.unescape("".join(self._held)).split())
        if line:
            self._put(line, min(self._linked, len(line)))
        if self._dropped:
            self._put("")
        self._held.clear()
        self._linked, self._dropped = 0, False

    def _border(self) -> None:
        for _ in range(WINDOW):
            self._put("")

    def _push(self, name: str, drops: bool) -> None:
        at = len(self._open)
        if name not in INLINE:
            self.parents.append(self._node())
            self.names.append(name)
            self._blocks.append(at)
        self._open.append((name, drops, len(self.names) - 1))
        self._by_name.setdefault(name, []).append(at)
        if name in DROP:
            self._drops.append(at)
        self._dropping += drops
        self._anchors += name == "a"
        if name in MAIN:
            self._mains.append(at)
            self._border()

    def _forget(self, at: int) -> None:
        """Take the element out of all counts; it is the last of its name."""
        name, drops, _ = self._open[at]
        self._by_name[name].pop()
        self._dropping -= drops
        self._anchors -= name == "a"
        if name in MAIN:
            self._border()
        for places in (self._blocks, self._mains, self._drops):
            if places and places[-1] == at:
                places.pop()

    def _close(self, at: int) -> None:
        """Close the element and all that are open in it."""
        while len(self._open) > at:
            if self._open[-1]:
                self._forget(len(self._open) - 1)
            self._open.pop()

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        if not self._by_name.get(name):
            return
        at = self._by_name[name][-1]
        if self._mains and self._mains[-1] > at or name not in MAIN and name not in DROP and self._drops and self._drops[-1] > at:
            return  # a stray tag doesn't close the menu or article that it stands in
        if name in INLINE:  # one that is closed late doesn't close the blocks opened in it
            self._forget(at)
            self._open[at] = None
            while self._open and self._open[-1] is None:
                self._open.pop()
        else:
            self._close(at)

    def _start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self._flush()
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or name[0] == "h" and name[1:].isdigit():
                # these end an open one of their own kind, and inline elements in it
                if self._blocks and self._open[self._blocks[-1]][0] == name:
                    self._close(self._blocks[-1])
        elif name == "br":
            self._text(" ")
        if name not in VOID and (name in INLINE or not attributes.endswith("/")):
            self._push(name, _dropped(name, attributes))

    def _read(self, page: str) -> None:
        at = 0
        while (start := page.find("<", at)) >= 0:
            m = TAG.match(page, start) or LOOSE.match(page, start)
            if not m:
                self._text(page[at : start + 1])
                at = start + 1
                continue
            self._text(page[at:start])
            at = m.end()
            if not m.lastindex or m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
            elif name not in RAW:
                self._start(name, m[3])
            elif not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        self._text(page[at:])
        self._flush()

    def containers(self) -> list[int]:
        """For each element the one that its text stands in: itself, or the one around blocks of text."""
        out: list[int] = []
        for k, name in enumerate(self.names):
            out.append(out[self.parents[k]] if name in TEXTUAL else k)
        return out


def between_surge_and_dive(sizes: list[int], surge: int = SURGE, window: int = WINDOW) -> list[tuple[int, int]]:
    """Regions [start, end) of lines: each from the first line with text after a dive (a line-block of length 0) to the last before the next dive, if some line-block in it surges.

    If no block surges, as on a page of one short line, these are all regions.
    """
    blocks = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    regions, start = [], None
    for i, n in enumerate(sizes):
        if n and start is None:
            start = i
        if start is not None and (i + 1 == len(sizes) or blocks[i + 1] == 0) and n:
            regions.append((start, i + 1))
            start = None
    surges = [(s, e) for s, e in regions if max(blocks[s:e]) >= surge]
    return surges or regions


def main_text(html_page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty if there are none."""
    if not html_page:
        return ""
    page = Page(html_page)
    lines, sizes = page.lines, [len(x) - n for x, n in zip(page.lines, page.links, strict=True)]
    if not any(sizes):  # a page of nothing but links has them as its text
        sizes = [len(x) for x in lines]
    regions = between_surge_and_dive(sizes)
    if not regions:
        return ""
    containers = page.containers()
    around = [containers[n] for n in page.nodes]
    chosen = [i for s, e in regions for i in range(s, e) if sizes[i]]
    root = [page.names[c] in ROOT for c in range(len(page.names))]
    own = {around[i] for i in chosen if not root[around[i]]}
    inside: list[bool] = []
    for k, parent in enumerate(page.parents):
        inside.append(k in own or k > 0 and inside[parent])
    bare = [i for i in chosen if root[around[i]]]
    kept = [False] * len(lines)
    for s, e in regions:
        kept[s:e] = [True] * (e - s)
    for i, n in enumerate(page.nodes):
        kept[i] = kept[i] or inside[n] or bool(bare) and root[around[i]] and (sizes[i] > 0 or bare[0] <= i <= bare[-1])
    return "\n\n".join(x for x, k in zip(lines, kept, strict=True) if x and k)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) of every page.

    One pass without shuffle, in Arrow batches of bounded bytes. Null or empty html gives an empty text; a null url stays null;
    repeated rows each get a row; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return map_batches(pages.select(*quote_columns(pages, id_col, url_col, html_col)), run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
