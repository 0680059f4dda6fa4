"""Pages by their tags: tables with tables inside them, named sections, links and form tokens, whatever the order of attributes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that never have an end tag; elements whose end a new one of the kinds named implies; elements whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th"), "li": ("li",), "p": ("p",), "option": ("option",)}
HIDDEN = frozenset(("script", "style", "template"))
#: Elements in which some version of ``HTMLParser`` doesn't look for tags.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: What stands between < and > in a tag that every parser reads alike: its name, after the slash of an end tag, and the slash of one that closes itself.
PLAIN_TAG = re.compile(r"""(/[a-zA-Z][a-zA-Z0-9]*+(?=[ \t\n\r\f]*+\Z)|[a-zA-Z][a-zA-Z0-9]*+)(?:[ \t\n\r\f]++[a-zA-Z][-a-zA-Z0-9_:.]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|[-a-zA-Z0-9_.:/#%+]++))?+)*+[ \t\n\r\f]*+(/?)""")
#: Of pages up to so many characters and tags, what those of the same tags have in common is remembered, of so many kinds of pages.
SHAPE_LENGTH, SHAPE_TAGS, SHAPES = 2**14, 1000, 256
#: Texts up to so many characters whose references are remembered once resolved, so many of them.
SHORT, TEXTS = 64, 4096
#: The headings of a fault page's sections and the keys they get.
SECTIONS = {
    "Fault Code Description": "fault_code_description", "Fault Code Conditions": "fault_code_conditions", "Fault Time Condition": "fault_time_condition", "Service Plan": "service_plan",
    "Fault Impact": "fault_impact", "Warnings": "warnings", "Service Notes": "service_notes",
}


class Element:
    """A tag with its attributes and what stands in it: texts and elements."""

    __slots__ = ("tag", "attributes", "inside")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.inside = tag, attributes, []

    def walk(self, stop: str | None = None) -> Iterator[Element]:
        """The elements below, in the page's order; not those inside an element ``stop``."""
        todo = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while todo:
            element = todo.pop()
            yield element
            if element.tag != stop:
                todo += [x for x in reversed(element.inside) if isinstance(x, Element)]

    def shown(self) -> Iterator[str]:
        """The shown texts, in the page's order."""
        todo = [self]
        while todo:
            x = todo.pop()
            if not isinstance(x, Element):
                yield x
            elif x.tag not in HIDDEN:
                todo += reversed(x.inside)

    def text(self) -> str:
        """The shown text, white space as single spaces."""
        return " ".join(" ".join(self.shown()).split())


class _Builder(HTMLParser):
    """Builds the tree. An end tag closes the nearest open element of its kind, but never reaches over the table it stands in; one that
    closes nothing is left out. Elements left open end with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end(ENDS.get(tag, ()), every=True)
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)})  # the first of equal names counts
        self.open[-1].inside.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._end((tag,), every=False)

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)

    def _end(self, kinds: tuple[str, ...], every: bool) -> None:
        """Close the nearest open element of the kinds; with ``every``, all of them down to the table, list or page they stand in."""
        found = None
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in kinds:
                found = at
                if not every:
                    break
            elif self.open[at].tag == "table" or every and self.open[at].tag in ("ul", "ol", "select", "div", "article"):
                break
        if found:
            del self.open[found:]


def parse(page: str | None) -> Element:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def _cells(row: Element) -> list[Element]:
    return [x for x in row.inside if isinstance(x, Element) and x.tag in ("td", "th")]


def _body_rows(root: Element, least: int) -> list[list[Element]]:
    """The data cells of the rows, of at least ``least`` of them, of the first table body."""
    body = next((e for e in root.walk() if e.tag == "tbody"), None)
    rows = [] if body is None else [[c for c in _cells(e) if c.tag == "td"] for e in body.walk(stop="table") if e.tag == "tr"]
    return [r for r in rows if len(r) >= least]


def _row_places(tags: tuple[str, ...], least: int) -> list[list[list[int]]] | None:
    """For pages of these tags, without their brackets: by row and cell which of the texts, each of which follows a tag, are shown in it. The tree is built
    as for a page, of the texts' numbers in place of the texts. None if a tag isn't plain or the tags after it needn't be tags."""
    builder = _Builder()
    for at, tag in enumerate(tags):
        plain = PLAIN_TAG.fullmatch(tag)
        name = plain[1].lower() if plain else ""
        if not name or name.lstrip("/") in RAW:
            return None
        if name[0] == "/":
            builder.handle_endtag(name[1:])
        elif plain[2]:
            builder.handle_startendtag(name, [])
        else:
            builder.handle_starttag(name, [])
        builder.handle_data(at)
    return [[list(c.shown()) for c in r] for r in _body_rows(builder.root, least)]


_remembered_places = lru_cache(SHAPES)(_row_places)
_remembered_text = lru_cache(TEXTS)(unescape)


def table_rows(page: str | None, least: int = 6) -> list[list[str]]:
    """The cell texts of the rows, of at least ``least`` data cells, of the page's first table body; of tables inside its cells only the text
    counts. Rows whose first or second cell is empty are left out.

    Where a page has plain tags only, it is cut at their brackets, and their tree is built once for pages of the same tags."""
    page = page or ""
    places = None
    if page.count("<") == page.count(">"):
        pieces = page.replace(">", "<>").split("<")  # if no tag begins with >, every text after a tag does
        tags, texts = tuple(pieces[1::2]), pieces[2::2]
        places = (_remembered_places if len(tags) <= SHAPE_TAGS and len(page) <= SHAPE_LENGTH else _row_places)(tags, least)
    if places is None:
        rows = [[c.text() for c in r] for r in _body_rows(parse(page), least)]
    else:
        resolved = lambda t: _remembered_text(t) if len(t) <= SHORT else unescape(t)

        def shown(cell: list[int]) -> str:
            text = texts[cell[0]][1:] if len(cell) == 1 else " ".join([texts[at][1:] for at in cell])
            return " ".join((" ".join([resolved(texts[at][1:]) for at in cell]) if "&" in text else text).split())

        rows = [[shown(c) for c in r] for r in places]
    return [r for r in rows if r[0] and r[1]]


def sections(page: str | None) -> dict[str, str]:
    """By section key the non-empty cell texts, one a line, of the table body after the heading that names it; '' if absent."""
    out = dict.fromkeys(SECTIONS.values(), "")
    done = set()
    for table in (e for e in parse(page).walk() if e.tag == "table"):
        heads = None
        for part in (x for x in table.inside if isinstance(x, Element)):
            if part.tag == "thead":
                heads = part.text().lower()
            elif part.tag == "tbody" and heads is not None:
                lines = [c.text() for e in part.walk(stop="table") if e.tag == "tr" for c in _cells(e)]
                for name, key in SECTIONS.items():
                    if name.lower() in heads and key not in done:
                        out[key] = "\n".join(x for x in lines if x)
                        done.add(key)
                heads = None
    return out


def links(page: str | None) -> list[tuple[str, str]]:
    """The addresses and texts of the links, in order; links without an address are left out."""
    return [(e.attributes["href"].strip(), e.text()) for e in parse(page).walk() if e.tag == "a" and e.attributes.get("href", "").strip()]


def token(page: str | None, name: str = "__RequestVerificationToken") -> str | None:
    """The value of the first input of that name that has one, in whichever order its attributes stand."""
    return next((e.attributes["value"] for e in parse(page).walk() if e.tag == "input" and e.attributes.get("name") == name and e.attributes.get("value")), None)


def blocks_text(page: str | None, kinds: tuple[str, ...] = ("article", "main")) -> str:
    """The text of the first content block of the kinds, else of the body, else of the page."""
    root = parse(page)
    elements = list(root.walk())
    for kind in (*kinds, "body"):
        if (found := next((e for e in elements if e.tag == kind), None)) is not None and (text := found.text()):
            return text
    return root.text()


def _column(kind: str, of: Callable, page: Column) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([of(p) for p in batch], dtype=object)

    return run(page)


def table_rows_column(page: Column, least: int = 6) -> Column:
    return _column("array<array<string>>", lambda p: table_rows(p, least), page)


def sections_column(page: Column) -> Column:
    """A map of the seven section keys."""
    return F.from_json(_column("string", lambda p: json.dumps(sections(p), ensure_ascii=False), page), "map<string, string>")


def links_column(page: Column) -> Column:
    """An array of structs ``(href, text)``."""
    pairs = _column("array<array<string>>", lambda p: [list(x) for x in links(p)], page)
    return F.transform(pairs, lambda x: F.struct(x[0].alias("href"), x[1].alias("text")))


def token_column(page: Column) -> Column:
    return _column("string", token, page)


def text_column(page: Column) -> Column:
    return _column("string", blocks_text, page)
