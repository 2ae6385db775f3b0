"""Main text of web pages by composite text density.

Every page becomes a tree of elements. A node's composite density is its
characters per tag, weighed down by the share of link characters and link tags
beneath it; its density sum adds up its children's densities and its own text.
The node with the largest sum is the page's core. The lowest density on the
path from it up to the body is the threshold: the core is joined by the
largest-sum subtrees of the other nodes that reach the threshold. An article
or main element that covers all of these is taken whole, else each of them
widens to the outermost article around it.

Elements that never hold an article's text (menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are left
out of the tree by their tag or by their class, id and role, unless they hold
an article or main element, or, where the page has none, the densest subtree.
A name of such words and others is a sure mark only for adverts, notices and
reader comments; for the rest the element's density decides.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
#: Elements that an opening of the given tag closes, and where the search for one ends.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
NOT_TEXT = frozenset("head nav footer aside form button select input script style textarea title xmp iframe noembed noframes noscript "
                     "template svg math canvas object audio video dialog menu search".split())
#: Words in class, id or role that mark an element as no part of the article.
CHROME = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside complementary contentinfo banner notice cookie cookies consent gdpr "
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist discussion "
    "disqus reply replies respond breadcrumb breadcrumbs share sharing social newsletter subscribe subscription signup login popup modal "
    "overlay related recommended widget pagination pager toolbar alert search form skip".split())
#: Words that stand beside those in a name that is still one of chrome.
BESIDE = frozenset("site page top bottom left right primary secondary inner outer box block wrapper wrap container area section list item items "
                   "links link bar content posts articles buttons icons policy".split())
#: Words that also name parts of an article: there the density decides.
EITHER = frozenset("header notice alert share sharing related recommended search form skip discussion reply replies respond subscription promotion widget".split())
#: Words that mark an element whatever stands beside them in the name, and words that turn a mark into its opposite.
SURE = frozenset("comment comments commentlist disqus ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo cookie "
                 "cookies consent gdpr newsletter".split())
TURNED = frozenset("no non not without has have with free hide hoc".split())
FRAME = frozenset(("html", "body", "article", "main"))
STRONG, WEAK = 2, 1
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""")
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Page:
    """The element tree in document order: node ``i``'s subtree is
    ``i .. end[i] - 1``. ``pieces`` are ``(node, text)`` in page order; a text
    of None ends a block."""

    def __init__(self, source: str, by_name: bool = True):
        self.tag, self.parent, self.end, self.pieces = ["#"], [-1], [0], []
        self._named = [0]
        self._stack: list[tuple[str, int, bool]] = [("#", 0, False)]
        self._open: dict[str, list[int]] = {}  # depths at which a tag is open, ascending
        self._blocks: list[int] = []  # and those of the open blocks
        self._open_p = -1
        self._by_name = by_name
        self._read(source)
        self._cut(1)
        self.end[0] = len(self.tag)
        if any(self._named):
            self._prune()

    def _cut(self, depth: int) -> None:
        """Close all elements from ``depth`` of the stack on."""
        for tag, node, skipped in reversed(self._stack[depth:]):
            self._open[tag].pop()
            if tag in BLOCK:
                self._blocks.pop()
            if not skipped:
                self.end[node] = len(self.tag)
                if tag in BLOCK:
                    self.pieces.append((node, None))
        del self._stack[depth:]
        if self._open_p >= depth:
            self._open_p = -1

    def _push(self, tag: str, node: int, skipped: bool) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append((tag, node, skipped))

    def _depth(self, tags) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _prune(self) -> None:
        """Drop the elements named as chrome."""
        density, total = densities(self)
        holders = [i for i, t in enumerate(self.tag) if t in ("article", "main")]
        holders = holders or [max(range(len(self.tag)), key=lambda i: (total[i], -i))]
        gone = [False] * len(self.tag)
        for i, how in enumerate(self._named):
            if gone[i] or not how or (how == WEAK and density[i] >= density[0]):
                continue
            at = bisect_left(holders, i)
            if at == len(holders) or holders[at] >= self.end[i]:
                gone[i:self.end[i]] = [True] * (self.end[i] - i)
        new, n = [], 0
        for x in gone:
            new.append(n)
            n += not x
        new.append(n)
        stay = [i for i, x in enumerate(gone) if not x]
        self.pieces = [(new[i], text) for i, text in self.pieces if not gone[i]]
        self.parent = [-1 if self.parent[i] < 0 else new[self.parent[i]] for i in stay]
        self.end = [new[self.end[i]] for i in stay]
        self.tag = [self.tag[i] for i in stay]
        self._named = [self._named[i] for i in stay]

    def _skipped(self, tag: str) -> bool:
        return tag in NOT_TEXT or (tag == "header" and not self._depth(("article", "main")))

    def _chrome(self, tag: str, attrs: str) -> int:
        if not self._by_name or tag in FRAME or not attrs or tag not in BLOCK and tag not in ("span", "a"):
            return 0
        found = 0
        for m in _NAMES.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                words = _WORDS.findall(name)
                if all(w in CHROME or w in BESIDE or w.isdigit() for w in words):
                    sure = any(w in CHROME and (w not in EITHER or m[1].lower() == "role") for w in words)
                    found = max(found, STRONG if sure else WEAK if any(w in EITHER for w in words) else 0)
                elif not any(w in TURNED for w in words):
                    found = max(found, STRONG if any(w in SURE for w in words) else WEAK if any(w in CHROME for w in words) else 0)
        return found

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK and self._open_p >= 0:
            self._cut(self._open_p)
        if tag in SIBLINGS:
            closes, stop = SIBLINGS[tag]
            if (depth := self._depth(closes)) > self._depth(stop):
                self._cut(depth)
        _, at, skipped = self._stack[-1]
        if tag in VOID:
            if not skipped:
                self.tag.append(tag)
                self._named.append(0)
                self.parent.append(at)
                self.end.append(len(self.tag))
                self.pieces.append((at, None if tag == "hr" else " " if tag == "br" else ""))
            return
        if skipped or self._skipped(tag):
            self._push(tag, at, True)
            return
        node = len(self.tag)
        self.tag.append(tag)
        self._named.append(self._chrome(tag, attrs))
        self.parent.append(at)
        self.end.append(0)
        if tag in BLOCK:
            self.pieces.append((node, None))
        if tag == "p":
            self._open_p = len(self._stack)
        self._push(tag, node, False)

    def _finish(self, tag: str) -> None:
        """An end tag closes its element; one of an inline element does not
        reach out of its block, and a stray one does nothing."""
        depth = self._depth((tag,))
        if depth and (tag in BLOCK or not self._blocks or depth > self._blocks[-1]):
            self._cut(depth)

    def _text(self, s: str) -> None:
        _, at, skipped = self._stack[-1]
        if s and not skipped:
            self.pieces.append((at, html.unescape(s) if "&" in s else s))

    def _read(self, source: str) -> None:
        pos, n, start = 0, len(source), 0  # start: where the text not yet taken begins
        while (lt := source.find("<", pos)) >= 0:
            if m := _TAG.match(source, lt):
                self._text(source[start:lt])
                close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
                tag = tag.lower()
                pos = start = m.end()
                if close:
                    self._finish(tag)
                    continue
                self._start(tag, attrs)
                if tag in RAW:
                    over = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, pos)
                    pos = start = over.start() if over else n
            elif source.startswith("<!--", lt):
                self._text(source[start:lt])
                over = source.find("-->", lt + 2)
                pos = start = over + 3 if over >= 0 else n
            elif source[lt + 1:lt + 2] in ("!", "?") or (source[lt + 1:lt + 2] == "/" and source[lt + 2:lt + 3].isascii()):
                self._text(source[start:lt])
                over = source.find(">", lt)
                pos = start = over + 1 if over >= 0 else n
            elif source[lt + 1:lt + 2].isalpha() and source[lt + 1:lt + 2].isascii():
                self._text(source[start:lt])  # a tag that the page's end cuts off
                pos = start = n
            else:
                pos = lt + 1  # a plain less-than sign
        self._text(source[start:])

    def blocks(self, keep: list[tuple[int, int]]) -> str:
        """Blocks of the subtrees ``keep`` (disjoint, in order), one a line."""
        out, block, i = [], [], 0
        for node, text in self.pieces:
            while i < len(keep) and node >= keep[i][1]:
                i += 1
            inside = i < len(keep) and keep[i][0] <= node
            if text is None or not inside:
                if block and (line := " ".join("".join(block).split())):
                    out.append(line)
                block = []
            if inside and text is not None:
                block.append(text)
        if block and (line := " ".join("".join(block).split())):
            out.append(line)
        return "\n".join(out)


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every node."""
    n = len(page.tag)
    own, chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.pieces:
        if text:
            own[node] += len(text.strip())
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tag[i] == "a" or linked[page.parent[i]]
    for i in range(n - 1, -1, -1):
        chars[i] += own[i]
        links[i] += own[i] if linked[i] else 0
        if i:
            p = page.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    share = links[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, links[i]), max(1, link_tags[i])
        if c:
            base = math.log(c / max(1, c - links[i]) * links[i] + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(c / lc * t / lt) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else math.log(max(1.0, c / lc * t / lt)))
    for i in range(n):
        total[i] += own[i]
        if i:
            total[page.parent[i]] += density[i]
    return density, total


def core(page: Page) -> list[tuple[int, int]]:
    """Subtrees that hold the main text, disjoint and in page order."""
    n = len(page.tag)
    density, total = densities(page)
    best = max(range(n), key=lambda i: (total[i], -i))
    if total[best] <= 0:
        return []
    path = []
    at = best
    while at > 0 and page.tag[at] not in ("body", "html"):
        path.append(at)
        at = page.parent[at]
    threshold = min((density[i] for i in [*path, at]), default=0.0)
    keep = [(best, page.end[best])]
    i = 1
    while i < n:
        if page.end[best] > i >= best:
            i = page.end[best]
        elif i < best < page.end[i] or density[i] < threshold:
            i += 1  # an ancestor of the core, or too thin: look inside
        else:
            top = max(range(i, page.end[i]), key=lambda j: (total[j], -j))
            if total[top] > 0:
                keep.append((top, page.end[top]))
            i = page.end[i]
    keep.sort()
    for name in ("article", "main"):
        over = next((j for j in range(1, n) if page.tag[j] == name and j <= keep[0][0] and keep[-1][1] <= page.end[j]), None)
        if over is not None:
            return [(over, page.end[over])]
    wide: list[tuple[int, int]] = []
    for a, b in keep:
        at = top = a
        while at > 0:
            top, at = (at if page.tag[at] == "article" else top), page.parent[at]
        if not wide or wide[-1][1] <= a:
            wide.append((top, page.end[top]))
    return wide


def main_text(source: str) -> str:
    """The main text of one page. Where nothing is left without the elements
    marked by name, they are read as well."""
    if not source:
        return ""
    for by_name in (True, False):
        page = Page(source, by_name)
        if text := page.blocks(core(page)):
            return text
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id``, ``url``, ``text`` and ``n_chars``
    (code points). A null or empty page, or one without text, has the empty
    text; null ids and urls stay null; repeated rows stay; extra columns are
    not read. Whole pages are read, one at a time."""
    src = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
