"""HTML extraction by tree scoring.

Each paragraph passes points, for its length and commas, to the elements around it: all of them to the nearest container,
half to the next, a quarter to the one above, and so on. A container's points are discounted by its link density. The best one is kept,
widened to the article that holds it if that scores beside it, or with siblings that score well or read like paragraphs. Menus,
footers, asides and forms go by element, and lists of links by their density. A role, class or id only makes an element suspect: sidebars, notices, adverts, comments
go by it, but not one that holds most of what the page has to say while there is little beside it (a wrapper named for its layout). Pages are read once, in time linear in their length whatever their nesting; they are independent of each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Elements whose text is never shown or never the article's.
_DROPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu audio video map datalist".split())
#: Elements that stand alone; that end a block; that end an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("body html caption dd dt li optgroup option tbody td tfoot th thead tr summary figcaption".split())
_PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption".split())
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
_STOPS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",)}
#: Words in class or id that tell what is not the article; roles that do.
_UNWANTED = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion promotions recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
_GOOD = frozenset("article content entry post story text body main".split())
#: Elements whose content is no markup, or none of the page's text, up to their own end tag.
_OPAQUE = frozenset("script style noscript template textarea title iframe svg".split())
#: A tag from its "<": attributes in quotes may hold ">". Possessive, so nothing is read twice; the last group is empty where the page ends inside the tag.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(>?)")
#: One attribute after the other, so what stands inside a value is never a name.
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
#: Points from which a suspect element can be what the page has to say; and its share of all points, and that of what isn't suspect, at most, of its own.
ENOUGH, MOST, BESIDE = 10.0, 0.5, 0.25
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class _Element:
    """``block``, ``scope`` and ``article``: the nearest block, the nearest element that bounds a paragraph, and whether an article is around; each may be itself."""

    __slots__ = ("tag", "up", "drop", "suspect", "points", "mass", "clean", "articles", "chars", "linked", "links", "good", "depth", "block", "scope", "article", "branch", "menu")

    def __init__(self, tag: str, up: _Element | None, drop: bool, good: bool = False, suspect: bool = False):
        self.tag, self.up, self.drop, self.good, self.suspect = tag, up, drop, good, suspect
        self.mass, self.clean, self.articles = 0.0, 0.0, 0
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0
        self.depth = up.depth + 1 if up else 0
        self.block = self if up is None or tag in _BLOCK else up.block
        self.scope = self if tag in ("p", "td", "th", "button") else up.scope if up else None
        self.article = tag in ("article", "main") or bool(up and up.article)
        self.branch: _Element | None = None
        self.menu = False

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _told(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, whether its role or names speak against it, and whether its names speak for it."""
    words, against = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, False
        if name == "role" and value.lower() in _ROLES:
            against = True
        if name in ("class", "id"):
            words |= {w.lower() for w in _NAME.findall(value)}
    good = bool(words & _GOOD)
    if tag in ("html", "body", "main") or words & {"with", "has", "no", "without"}:
        return False, against, good
    if tag == "article":
        return False, against or bool(words & {"comment", "comments", "ad", "advert", "sponsored", "promo", "related"}), good
    return False, against or bool(words & _UNWANTED or "header" in words and not in_article and not good), good


class _Page:
    """A page read once, from left to right. ``elements`` stand in order of their start tags, parents first."""

    def __init__(self, page: str):
        self.root = self.here = self.owner = _Element("html", None, False)
        self.elements = [self.root]
        self.blocks: list[tuple[_Element, str]] = []
        self.pieces: list[str] = []
        self.linked = self.links = 0
        self.in_link = False
        self.open: dict[str, list[_Element]] = {}
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        at = 0
        while (start := page.find("<", at)) >= 0:
            self._add(page[at:start])
            head = page[start : start + 4]
            if head == "<!--":
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
            elif m := _TAG.match(page, start):
                at, tag = m.end(), m[2].lower()
                if not m[4]:
                    return  # the page ends inside a tag
                if m[1]:
                    self._end(tag)
                elif tag in _OPAQUE:
                    end = re.compile(rf"</{tag}(?![^\s/>])[^>]*+>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    self._start(tag, m[3])
            elif head[1:2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            else:
                self._add("<")
                at = start + 1
        self._add(page[at:])

    def _add(self, text: str) -> None:
        if self.here.drop or not text:
            return
        if not self.pieces:
            self.owner = self.here.block
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append((self.owner, text))
                self.owner.chars += len(text)
                self.owner.linked += min(len(text), self.linked)
                self.owner.links += self.links
        self.pieces, self.linked, self.links = [], 0, 0

    def _close(self, e: _Element) -> None:
        """``e`` and all that is open inside it."""
        while self.here is not e.up:
            self.open[self.here.tag].pop()
            self.here = self.here.up

    def _end(self, tag: str) -> None:
        found = self.open.get(tag)
        if tag == "a":
            self.in_link = False
        if tag in _BLOCK:
            self._flush()
            if found:
                self._close(found[-1])
                self.in_link = False
        elif found and found[-1].depth > self.here.block.depth:
            self._close(found[-1])

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCK
        if block or tag == "br":
            self._flush()
        if tag in _ENDS_P and self.here.scope is not None and self.here.scope.tag == "p":
            self._close(self.here.scope)
        if tag in _CLOSES:
            e, last = self.here.block, None
            while e is not self.root and (e.tag in _CLOSES[tag] or e.tag == "p") and e.tag not in _STOPS.get(tag, ("table",)):
                last = e if e.tag in _CLOSES[tag] else last
                e = e.up.block
            if last is not None:
                self._close(last)
        if tag in _VOID or tag == "html":
            return
        here = self.here
        drop, suspect, good = (here.drop, False, False) if here.drop else _told(tag, attributes, here.article) if "=" in attributes or "hidden" in attributes.lower() else (False, False, False)
        drop = drop or suspect and not block or tag in _DROPPED or tag == "header" and not here.article
        if attributes.endswith("/") and not block:
            return
        self.here = _Element(tag, here, drop, good, suspect and not drop)
        self.elements.append(self.here)
        self.open.setdefault(tag, []).append(self.here)
        if tag == "a" and not drop:
            self.in_link = True
            self.links += 1


def _points(text: str) -> float:
    return 1 + text.count(",") + text.count("、") + min(len(text) // 100, 3)


def _counts(own: _Element, text: str) -> bool:
    """Whether a block's points count: it is long enough, and no heading."""
    return len(text) >= 25 and own.tag not in ("h1", "h2", "h3", "h4", "h5", "h6")


def _decide(read: _Page) -> None:
    """Suspect elements are dropped or spared, outer ones first.

    ``mass`` is the points inside an element, ``clean`` those of them in no suspect inside it. What isn't suspect speaks
    for itself; a suspect is spared if it holds MOST of the page and what was found beside it so far is little, and no article of its own.
    """
    for own, text in read.blocks:
        if _counts(own, text):
            points = _points(text) * (1 - own.density())
            own.mass, own.clean = own.mass + points, own.clean + points
    for e in read.elements:
        e.articles += e.tag in ("article", "main") and not e.suspect and not e.drop
    for e in reversed(read.elements[1:]):
        e.up.mass += e.mass
        if not e.suspect:
            e.up.clean, e.up.articles = e.up.clean + e.clean, e.up.articles + (e.articles if e.mass else 0)
    root = read.root
    known, articles = root.clean, root.articles
    for e in read.elements[1:]:
        e.drop = e.drop or e.up.drop
        if e.suspect and not e.drop:
            large = e.mass >= ENOUGH or e.articles or e.tag == "article"
            if large and e.mass > MOST * root.mass and known < BESIDE * e.mass and not articles:
                known, articles = known + e.clean, articles + e.articles + (e.tag == "article")
            else:
                e.drop = True


def main_text(page: str | None) -> str:
    """The article of a page as one string; empty if there is none. Every step is linear in the page, however long or deep it is."""
    read = _Page(page or "")
    _decide(read)
    elements, root = read.elements, read.root
    blocks = [(own, t) for own, t in read.blocks if not own.drop]
    for e in elements:
        if e.drop:
            e.chars = e.linked = e.links = 0
    for e in reversed(elements[1:]):
        e.up.chars, e.up.linked, e.up.links = e.up.chars + e.chars, e.up.linked + e.linked, e.up.links + e.links
    for e in elements:
        e.menu = e.tag in ("ul", "ol", "dl", "div", "section", "table", "p") and e.links >= 3 and e.density() > 0.8 or bool(e.up and e.up.menu)
    blocks = [(own, t) for own, t in blocks if not own.menu]
    if not blocks:
        return ""
    for own, text in blocks:
        if _counts(own, text):
            (own if own.tag not in _PARAGRAPH or own.up is None else own.up).points += _points(text)
    for e in reversed(elements[1:]):  # half to the next container, a quarter to the one above, and so on
        e.up.points += e.points / 2
    bonus = {"article": 25.0, "main": 10.0}
    value = lambda e: (e.points + (bonus.get(e.tag, 5.0 if e.good else 0.0) if e.points else 0.0)) * (1 - e.density())
    scored = [e for e in elements if e.points]
    if scored:
        best = max(scored, key=value)
    else:
        best = max((e for e in elements if e.tag == "article" and e.chars), key=lambda e: e.chars, default=root)
    for tag in ("article", "main"):  # the article around the best container, if its own score stands beside it
        e = best
        while e is not None and e.tag != tag:
            e = e.up
        if e is not None and value(e) >= 0.2 * value(best):
            best, whole = e, True
            break
    else:
        whole = best.up is None
    for e in elements[1:]:
        e.branch = e if e is best or not whole and e.up is best.up else e.up.branch
    if best is root:
        return " ".join(t for _, t in blocks)
    keep = {best}
    if not whole:
        least = max(10.0, 0.2 * value(best))
        for own, text in blocks:
            side = own.branch
            if side is None or side in keep:
                continue
            reads = side.tag == "p" and (side.chars > 80 and side.density() < 0.25 or side.density() == 0 and text[-1:] in ".!?")
            if value(side) >= least or reads or side.tag in ("h1", "h2"):
                keep.add(side)
    return " ".join(t for own, t in blocks if own.branch in keep)


def _extracted(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pages:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of ``pages``.

    Null and empty pages, and pages without text, give an empty text. Repeated rows are read one by one; other columns don't matter.
    """
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return slim.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
