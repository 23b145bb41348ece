"""Links of listing pages with the elements around them: what a card says beside its link.

A streaming parser follows the open elements; an element's text is a range of the page's pieces of text, so nested ones
share them.  Each link knows its path of open elements, the heading that it stands in, and its innermost ``DEPTH`` elements
(its *cards*), which are kept once for a page.  What an adapter makes of them is Column expressions (``sources.listings``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import HIDDEN, VOID, slices, squeeze

#: Elements around a link that are kept, innermost first.
DEPTH = 6
HEADS = ("h1", "h2", "h3", "h4", "h5", "strong")
#: Elements that end another of their kind where its end tag is left out.
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}
_LINK = pa.struct([*((n, pa.string()) for n in ("tag", "href", "label", "rel", "aria", "hint")), ("path", pa.list_(pa.string())), ("heading", pa.int32()), ("cards", pa.list_(pa.int32()))])
_CARD = pa.struct([("tag", pa.string()), ("marks", pa.string()), ("text", pa.string()), ("heads", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))), ("hrefs", pa.list_(pa.string()))])
SCHEMA = (
    "row bigint, links array<struct<tag: string, href: string, label: string, rel: string, aria: string, hint: string, path: array<string>, heading: int, cards: array<int>>>, "
    "cards array<struct<tag: string, marks: string, text: string, heads: array<struct<tag: string, text: string>>, hrefs: array<string>>>"
)


class Element:
    def __init__(self, tag: str, marks: str, number: int, start: int) -> None:
        self.tag, self.marks, self.number, self.start, self.stop = tag, marks, number, start, start
        self.hrefs: dict[str, None] = {}


class Outline(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[Element] = []
        self.every: list[Element] = []
        self.links: list[tuple[dict, Element | None, list[Element]]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "a":
            self.shut({"a"})
        for i in range(len(self.open) - 1, -1, -1):  # an end tag that was left out
            if self.open[i].tag in ENDS.get(tag, ()):
                self.shut({self.open[i].tag})
                break
            if self.open[i].tag in ("ul", "ol", "table", "select", "div", "section", "article"):
                break
        self.hidden += tag in HIDDEN
        own = Element(tag, given.get("class", ""), len(self.every), len(self.pieces))
        if tag in ("a", "link") and (href := given.get("href", "").strip()):
            for e in self.open:
                e.hrefs[href] = None
            fields = {"tag": tag, "href": href, "rel": given.get("rel", "").lower(), "aria": given.get("aria-label", ""), "hint": given.get("title", "")}
            self.links.append((fields, own, list(self.open)))
        if tag not in VOID:
            self.every.append(own)
            self.open.append(own)

    def shut(self, tags: set[str]) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag in tags), None)
        if at is not None:
            for e in self.open[at:]:
                e.stop = len(self.pieces)
            del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        self.shut({tag})

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)

    def text(self, e: Element) -> str:
        return squeeze(self.pieces[e.start : e.stop])

    def outline(self) -> tuple[list[dict], list[dict]]:
        heads = [e for e in self.every if e.tag in HEADS]
        cards: dict[int, int] = {}
        kept: list[Element] = []
        links = []
        for fields, own, around in self.links:
            mine = []
            for e in around[: -DEPTH - 1 : -1]:
                if e.number not in cards:
                    cards[e.number] = len(kept)
                    kept.append(e)
                mine.append(cards[e.number])
            heading = next((e.number for e in reversed(around) if e.tag in HEADS[:4]), None)
            path = [".".join([e.tag, *e.marks.split()]) for e in around]
            links.append(fields | {"label": self.text(own) if own.tag == "a" else "", "path": path, "heading": heading, "cards": mine})
        described = []
        for e in kept:
            first: dict[str, str] = {}
            for h in heads:
                if e.number < h.number and h.start >= e.start and h.stop <= e.stop and h.tag not in first and (text := self.text(h)):
                    first[h.tag] = text
            described.append({"tag": e.tag, "marks": e.marks, "text": self.text(e), "heads": [{"tag": t, "text": x} for t, x in first.items()], "hrefs": list(e.hrefs)})
        return links, described


def outline(source: str | None) -> tuple[list[dict], list[dict]]:
    """Links and cards of a page; a null page has none."""
    page = Outline()
    page.feed(source or "")
    page.close()
    for e in page.open:
        e.stop = len(page.pieces)
    return page.outline()


def linked(pages: DataFrame, html: str) -> DataFrame:
    """``pages``, without ``html``, with ``links`` and ``cards`` of each."""
    rest = [c for c in pages.columns if c != html]
    place = pages.columns.index(html)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    names = [*rest, "links", "cards"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place)):
            found = [outline(x.as_py()) for x in batch.column(place)]
            others = [batch.column(i) for i, c in enumerate(batch.schema.names) if i != place]
            yield pa.RecordBatch.from_arrays([*others, pa.array([f[0] for f in found], pa.list_(_LINK)), pa.array([f[1] for f in found], pa.list_(_CARD))], names=names)

    return pages.mapInArrow(read, ", ".join(filter(None, [schema, SCHEMA.split(", ", 1)[1]])))


def within(link: Column, *tags: str) -> Column:
    """Whether one of the elements that a link stands in is of these tags."""
    pattern = f"^(?:{'|'.join(map(re.escape, tags))})(?:\\.|$)"
    return F.exists(link["path"], lambda p: p.rlike(pattern))


def nearest(cards: Column, *tags: str) -> Column:
    """The innermost of a link's cards that is of these tags."""
    return F.get(F.filter(cards, lambda c: c["tag"].isin(*tags)), F.lit(0))


def own_cards(link: Column, cards: Column) -> Column:
    """A link's cards, innermost first."""
    return F.transform(link["cards"], lambda i: F.get(cards, i))
