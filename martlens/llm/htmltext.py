"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element.  Lines of parts that are never
main text (menus, site headers, footers, sidebars, notices, adverts, forms, reader
comments, hidden parts) are left out, and lines that are mostly links weigh nothing; other
lines weigh their length.  Sums over sliding windows of ``WINDOW`` lines rise at the surge
and fall at the dive of the main text, and all such stretches are kept with the light lines
between them.  Surge and dive then move to the edges of the element that holds the text: the
outermost article or main around a stretch where the page marks them, else the innermost
element around the heavy lines.  A short first or last paragraph then stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.bpe import slices

WINDOW = 3
LEAST = 80  # a window of fewer characters is no surge, if the page has a heavier one

TAKEN_BACK = 8  # names that may prove wrong one inside the other; beyond that none counts

# Element names of HTML by their role here.
_RAW = "script|style|title|textarea|noscript|iframe|template|xmp|noembed|noframes|svg|math"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset(("br", "td", "th", "img", "wbr"))
_NEVER = frozenset(
    "nav footer aside form button select menu dialog object audio video canvas head".split()
)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_IN_HEAD = frozenset(f"html head base basefont bgsound link meta {_RAW}".replace("|", " ").split())
_HOLDERS = frozenset(("header", "div", "section", "form"))
_SCOPES = frozenset("ul ol dl table article div section button select object".split())
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split()
)
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert sidebar sidebars nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply share "
    "sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay search widget widgets pagination pager toolbar copyright disclaimer".split()
)
# Words that say nothing about what they stand beside: site-header, comment-list-wrapper.
_NEUTRAL = frozenset(
    "site page main global top bottom left right upper lower primary secondary first last entry post "
    "posts article articles block blocks box boxes bar bars wrap wrapper container inner outer list "
    "lists item items area areas section sections row col column columns grid button buttons link "
    "links icon icons slot unit text title form field panel group set js el".split()
)
# Names that never mean the article, however much text they hold beside it.
_SURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments "
    "disqus newsletter subscribe subscription".split()
)
_READERS = frozenset("comment comments disqus respond thread list area section".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>?|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(
    r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S
)
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")  # of names written like-this, like_this or likeThis
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(value: str) -> tuple[set[str], bool]:
    """Hint words of class or id names that say just that, and if others hold one as well.

    A name says just that if its other words are neutral: ``cookie-notice``, not
    ``no-sidebar``.
    """
    plain, mixed = set(), False
    for name in value.split():
        words = [w.lower() for w in _PART.findall(name) if len(w) > 1]
        found = _HINTS.intersection(words)
        if found and all(w in _HINTS or w in _NEUTRAL for w in words):
            plain |= found
        elif found:
            mixed = True
    return plain, mixed


class _Element:
    """A tag's element; ``link``, ``titled`` and ``holder`` hold for all inside it as well."""

    __slots__ = ("name", "outer", "block", "drop", "head", "hinted", "mixed", "sure", "article",
                 "freed", "link", "titled", "holder", "never", "margin", "top", "size", "solid")

    def __init__(self, name: str, attributes: str, outer: _Element | None):
        self.name, self.outer, self.article = name, outer, name in ("article", "main")
        self.block = self if outer is None or name in _BLOCK else outer.block
        self.drop, self.head, self.size = name in _NEVER, name == "header", 0
        self.hinted = self.mixed = self.sure = self.freed = self.solid = False
        self.link = name == "a" or outer is not None and outer.link
        self.titled = name in _HEADING or outer is not None and outer.titled
        inside = None if outer is None else outer.holder  # the outermost article or main
        self.holder = inside or (self if self.article else None)
        if attributes and attributes != "/":
            self._read(attributes, inside is not None)
        if self.head and inside is None:  # beside an article its headings go as well
            self.drop |= name == "header"
            self.hinted = True

    def _read(self, attributes: str, inside: bool) -> None:
        # in an article words may be its subject: only classes and roles of blocks count
        named = not inside or self.name in _BLOCK and self.name not in _HEADING
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "class" and named or key == "id" and not inside and self.name not in _HEADING:
                found, mixed = _named(value)
                self.head |= "header" in found
                self.hinted |= bool(found - {"header"})
                self.sure |= not found.isdisjoint(_SURE)
                self.mixed |= mixed and not inside
            elif key == "id" and named and inside:
                found = set(_WORD.findall(value.lower()))
                self.hinted |= found <= _READERS and not found.isdisjoint(_HINTS)
                self.sure |= self.hinted
            elif key == "role" and named:
                self.hinted |= not _ROLES.isdisjoint(value.lower().split())
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                self.hinted = self.sure = True
            elif key == "style" and _HIDDEN.search(value) is not None:
                self.hinted = self.sure = True
        if self.name in ("html", "body", "main"):
            self.hinted = self.head = self.mixed = False


class _Line:
    """Texts of one block, each with its innermost element; spaces have none."""

    __slots__ = ("parts", "block")

    def __init__(self, block: _Element):
        self.parts: list[tuple[str, _Element | None]] = []
        self.block = block


class _Open:
    """The stack of open elements, and how many of each name are on it."""

    def __init__(self):
        self.stack = [_Element("", "", None)]
        self.names: Counter[str] = Counter()

    def push(self, element: _Element) -> None:
        self.stack.append(element)
        self.names[element.name] += 1

    def close(self, names: frozenset | set, scopes: frozenset | tuple = ()) -> bool:
        """Close the innermost open element of these names; whether a block ended by that.

        A search passes only elements that it closes, or ends at a scope.
        """
        if not any(self.names[n] for n in names):
            return False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                gone = self.stack[k:]
                del self.stack[k:]
                for e in gone:
                    self.names[e.name] -= 1
                return any(e.name in _BLOCK for e in gone)
            if self.stack[k].name in scopes:
                break
        return False


def lines_of(page: str) -> tuple[list[_Element], list[_Line]]:
    """The page's elements, outer before inner ones, and its lines of text."""
    opened = _Open()
    stack = opened.stack
    elements, lines = stack[:], []
    line: _Line | None = None
    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            if stack[-1].name == "head" and not text.isspace():
                opened.close({"head"})
                line = None
            if line is None:
                line = _Line(stack[-1].block)
                lines.append(line)
            line.parts.append((text, stack[-1]))
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        # the end tag of a head may be left out: what cannot be in a head ends it
        if not token["end"] and name not in _IN_HEAD and opened.close({"head"}):
            line = None
        if name in _BLOCK:
            line = None
        elif (name in _SPACED or name in _NEVER) and line is not None:
            line.parts.append((" ", None))
        if token["end"]:
            if opened.close({name}):
                line = None
            continue
        if name in _VOID:
            continue
        closing = _CLOSED_BY.get(name)
        if name in _BLOCK and name not in ("html", "body"):
            closing = (closing or set()) | {"p"}
        if closing:
            opened.close(closing, _SCOPES)
        element = _Element(name, token["attributes"], stack[-1])
        elements.append(element)
        if element.article and not element.hinted:
            # what holds an article is no margin, whatever it is called
            outer = element.outer
            while outer is not None and not outer.freed:
                outer.hinted = outer.head = outer.mixed = False
                outer.drop &= outer.name not in _HOLDERS
                outer.freed = True
                outer = outer.outer
        opened.push(element)
        if name in _BLOCK:
            line = None
    return elements, lines


def _judge(elements: list[_Element], forms: bool = True) -> None:
    """Carries what drops text from outer to inner elements; ``forms`` tells if forms do."""
    for e in elements:
        e.never = e.drop and (forms or e.name != "form")
        e.margin, e.top = e.hinted, e.head
        if e.outer is not None:
            e.never |= e.outer.never
            e.margin |= e.outer.margin
            e.top |= e.outer.top


def _free_forms(elements: list[_Element], lines: list[_Line]) -> None:
    """A form around most of the page's text is the page itself: it drops nothing.

    Texts that something else drops do not count, nor do those of links.
    """
    forms = [e for e in elements if e.drop and e.name == "form"]
    if not forms:
        return
    _judge(elements, forms=False)
    for line in lines:
        for text, e in line.parts:
            if e is not None and not (e.link or _dropped(e, True)):
                e.size += len(text.strip())
    for e in reversed(elements):
        if e.outer is not None:
            e.outer.size += e.size
    for form in forms:
        form.drop = 2 * form.size <= elements[0].size


def _weigh(elements: list[_Element], lines: list[_Line]) -> None:
    """``size``: text of an element that no tag drops and no link holds; and if it is solid.

    An element is solid if a line in it weighs as much as a surge.  A name with a hint among
    other words counts only where nothing solid is inside.
    """
    for e in elements:
        e.size = 0
    for line in lines:
        sizes = [(e, len(t.strip())) for t, e in line.parts if e is not None and not e.never]
        linked = sum(n for e, n in sizes if e.link)
        whole = sum(n for _, n in sizes)
        for e, n in sizes:
            if not e.link:
                e.size += n
        line.block.solid |= whole >= LEAST and 2 * linked <= whole
    for e in reversed(elements):
        if e.outer is not None:
            e.outer.size += e.size
            e.outer.solid |= e.solid
    for e in elements:
        e.hinted |= e.mixed and not e.solid


def _wrongly_named(elements: list[_Element], kept: list) -> _Element | None:
    """The heaviest part that a name drops, if what it leaves is next to nothing.

    That is the case if no surge is left and the part holds more than all that is left.
    While something is left, a name that is sure, or hides its part, stays as it is.
    """
    weight = np.array([w for *_, w in kept], np.int64)
    if len(weight) and window_sums(weight, WINDOW).max() >= LEAST:
        return None
    found = [
        e for e in elements
        if (e.hinted or e.head) and e.size > weight.sum() and not (kept and e.sure)
        and not (e.outer.margin or e.outer.top or e.outer.never)
    ]
    return max(found, key=lambda e: e.size, default=None)


def _dropped(e: _Element, hints: bool) -> bool:
    """Whether a part that is no main text holds the element; headings of an article stay."""
    return e.never or hints and (e.margin or e.top and not e.titled)


def _left(lines: list[_Line], hints: bool) -> list[tuple[_Line, str, int]]:
    """Lines with text left, that text, and its weight: its length, or 0 if mostly links."""
    out = []
    for line in lines:
        parts = [(t, e) for t, e in line.parts if e is None or not _dropped(e, hints)]
        # text that ends in a bare "&" or "<" is joined before references are read
        text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        if text:
            sizes = [(len(t.strip()), e.link) for t, e in parts if e is not None]
            linked = sum(n for n, link in sizes if link)
            heavy = 2 * linked <= sum(n for n, _ in sizes)
            out.append((line, text, len(text) if heavy else 0))
    return out


def window_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """Sum of each line's weight and the following ones of its window."""
    total = np.concatenate([[0], np.cumsum(weights), np.full(window - 1, weights.sum())])
    return total[window:] - total[:-window]


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by empty lines; empty if there are none.

    Names of classes and ids never leave a page with next to nothing: the heaviest part
    that they drop is then taken back, and the page looked at again.
    """
    elements, lines = lines_of(page or "")
    _free_forms(elements, lines)
    _judge(elements)
    _weigh(elements, lines)
    _judge(elements)
    kept = _left(lines, True)
    for _ in range(TAKEN_BACK):
        wrong = _wrongly_named(elements, kept)
        if wrong is None:
            break
        wrong.hinted = wrong.head = False
        wrong.drop &= wrong.name not in _HOLDERS
        _judge(elements)
        kept = _left(lines, True)
    if not any(line.block.holder for line, *_ in kept):
        # names that would drop every line of an article mean something else here
        kept = _left([x for x in lines if x.block.holder], False) or kept
    if not kept:
        kept = _left(lines, False)
    if not kept:
        return ""
    blocks = [line.block for line, *_ in kept]
    texts = [text for _, text, _ in kept]
    weight = np.array([w for *_, w in kept], np.int64)
    chosen = _chosen(weight, blocks, elements)
    return "\n\n".join(t for t, c in zip(texts, chosen, strict=True) if c)


def _chosen(weight: np.ndarray, blocks: list[_Element], elements: list[_Element]) -> np.ndarray:
    """The lines of the main text: surge and dive, widened by the page's marks.

    Stretches of heavy windows are located on the whole page.  Where those in articles (or
    main) weigh as much as the heaviest outside, they are the main text, and each widens to
    the outermost article around it; an article beside it in the same element belongs to it.
    Else the page marks something else as well: all stretches stay, and the articles too.
    """
    marked = np.array([b.holder is not None for b in blocks])
    if not marked.any():
        return _between(weight, blocks, elements)
    solid, outside = np.zeros(len(weight), bool), 0
    for a, b in _stretches(weight, short=False):
        solid[a:b] = True
        outside = max(outside, int(np.where(marked, 0, weight)[a:b].sum()))
    located = marked & solid & (weight > 0)
    decided = weight[located].sum() >= outside
    if not located.any():  # short articles have no heavy window
        located = marked & (weight > 0)
    if not located.any() and not outside:
        located = marked  # articles of links alone
    holders = {blocks[i].holder for i in np.flatnonzero(located).tolist()}
    beside = {e.outer for e in holders}
    for i in np.flatnonzero(marked & (weight > 0)).tolist():
        if blocks[i].holder.outer in beside:
            holders.add(blocks[i].holder)
    chosen = _within(blocks, elements, holders)
    return chosen if decided else chosen | _between(weight, blocks, elements)


def _holder(blocks: list[_Element]) -> _Element | None:
    """The innermost element around all of the blocks, if it is less than the page."""
    if len(blocks) < 2:
        return None
    depth, up = {}, blocks[0]
    while up is not None:  # the first block and all around it, by distance
        depth[up] = len(depth)
        up = up.outer
    shared = blocks[0]
    seen = set(depth)
    for block in blocks[1:]:
        while block not in seen:  # no element is passed twice
            seen.add(block)
            block = block.outer
        if depth.get(block, -1) > depth[shared]:
            shared = block
    return None if _whole(shared) else shared


def _stretches(weight: np.ndarray, short: bool = True) -> list[tuple[int, int]]:
    """Every surge and its dive: runs of heavy windows, without weightless lines at the ends.

    On a page of short lines no window is heavy; there a run of lines counts that has no
    weightless window and ``LEAST`` characters as a whole, or, if there is none and
    ``short`` allows it, any.
    """
    sums = window_sums(weight, WINDOW)
    out = []
    for least, whole in ((LEAST, LEAST), (1, LEAST), (1, 1))[: 3 if short else 2]:
        edges = np.diff(np.concatenate([[0], (sums >= least).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            some = a + np.flatnonzero(weight[a : b + WINDOW - 1])
            if weight[some].sum() >= whole:
                out.append((int(some[0]), int(some[-1]) + 1))
        if out:
            break
    return out


def _within(blocks: list[_Element], elements: list[_Element], holders: set) -> np.ndarray:
    """Whether each block is one of the holders or inside one."""
    inside = set()
    for e in elements:  # outer before inner ones
        if e in holders or e.outer in inside:
            inside.add(e)
    return np.array([b in inside for b in blocks], bool)


def _whole(e: _Element) -> bool:
    return e.name in ("", "html", "body")


def _between(
    weight: np.ndarray, blocks: list[_Element], elements: list[_Element]
) -> np.ndarray:
    """The lines between surge and dive of all stretches in the block they share.

    What lies between two stretches stays, but for windows of links alone where the heavy
    lines before and after are not in the same element.  The first surge and the last dive
    move on to a weightless window or the edge of the block.  An element that directly
    holds several heavy lines is kept as a whole.
    """
    n = len(weight)
    # beside an empty article a few words are no text
    short = not any(e.article for e in elements)
    chosen, found = np.zeros(n, bool), _stretches(weight, short)
    if not found:
        return chosen
    for a, b in found:
        chosen[a:b] = True
    heavy = np.flatnonzero(chosen & (weight >= LEAST))
    if not len(heavy):
        heavy = np.flatnonzero(chosen & (weight > 0))
    parents: dict[_Element, int] = {}
    for i in heavy.tolist():
        for e in (blocks[i], blocks[i].outer):
            if e is not None and not _whole(e):
                parents[e] = parents.get(e, 0) + 1
    around = _holder([blocks[i] for i in heavy.tolist()])
    inside = np.ones(n, bool) if around is None else _within(blocks, elements, {around})

    empty = np.zeros(n, bool)  # lines of a window without weight
    for i in range(n - WINDOW + 1):
        if not weight[i : i + WINDOW].any():
            empty[i : i + WINDOW] = True
    first, last = found[0][0], max(b for _, b in found)
    for a, b in zip(heavy[:-1].tolist(), heavy[1:].tolist(), strict=True):
        chosen[a:b] |= ~empty[a:b] | (blocks[a].outer is blocks[b].outer)
    chosen[first:last] |= ~empty[first:last]

    siblings = {blocks[i].outer for i in heavy.tolist()}
    for outward in (range(first - 1, -1, -1), range(last, n)):
        light = []
        for i in outward:
            if empty[i] or not inside[i]:
                break
            if weight[i] and (around is not None or blocks[i].outer in siblings):
                light.append(i)
        if light and (around is not None or weight[light].sum() >= LEAST):
            chosen[min(first, light[-1]) : max(last, light[-1] + 1)] |= ~empty[
                min(first, light[-1]) : max(last, light[-1] + 1)]
    chosen |= _within(blocks, elements, {e for e, count in parents.items() if count > 1})
    chosen &= inside
    start = int(chosen.argmax())
    while start and blocks[start - 1].titled:  # a heading right before the text is its own
        start -= 1
        chosen[start] = True
    return chosen


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    White space inside a block is one space, character references are decoded, blocks are
    joined in page order by two line ends.  A null, empty or textless page has an empty
    text.  Null and repeated ids keep a row each; other columns are left behind; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "html"):
                texts = [main_text(p) for p in small.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": small.column("page_id"), "url": small.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(map(len, texts), pa.int64()),
                })

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
