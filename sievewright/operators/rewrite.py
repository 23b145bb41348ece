"""Rewriting of generated markup at source positions: a parser that keeps offsets, edits, one pass that applies them.

Each rewriter looks at the page as it was and gives edits (start, stop, new text); what no edit touches stays as it is, byte for byte.
Edits inside a removed range are dropped, and no rewriter looks for a place in one; so the order of the rewriters does not matter.
Additions at the end come in the order of ``REWRITERS``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cards import ENDS
from .html import EMPTY_VALUES, HIDDEN, VOID, slices, squeeze

# Labels of rows that are for the pipeline alone.
INTERNAL = re.compile(
    r"^(?:تاريخ\s+النشر|تاريخ\s+نشر\s+(?:الإعلان|الوظيفة)|تاريخ\s+الإعلان|(?:تم\s+)?نشر(?:ت)?\s+(?:الإعلان|الوظيفة)\s*(?:بتاريخ)?|date\s+de\s+publication|publication\s+date|published\s+on|"
    r"المصدر|مصدر\s+(?:الخبر|الوظيفة|الإعلان)|نقلا\s+عن|المرجع|مرجع\s+(?:الإعلان|الوظيفة|المباراة)|(?:ال)?رقم\s+(?:المرجعي|المرجع|الإعلان|المباراة)|رمز\s+المباراة|"
    r"r[eé]f(?:[ée]rence)?\.?|reference(?:\s+(?:no\.?|number))?)\s*[:：-]?", re.I)  # fmt: skip
# Most characters of an internal paragraph; words that carry the link to the hub, and the paragraph that does where none is there.
MOST_INTERNAL = 320
HUB_WORDS = re.compile("(وظائف|التوظيف|الوظيفة|الترشيح|العمل)")
HUB_TEXT, HUB_LABEL = "للاطلاع على المزيد، راجع ", "قسم الوظائف"
# Classes of the links that lead to an action.
CLASSES = {"detail": ("extL", "jobOfficialDetailLink"), "apply": ("button", "extL", "jobApplyButton"), "application_channel": ("button", "extL", "jobApplyButton", "jobApplicationChannelButton"), "document": ("button", "extL", "jobDocumentButton")}
REL = "nofollow noreferrer noopener"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    start: int
    inner: int
    end: int = -1
    stop: int = -1
    parents: tuple[Node, ...] = ()
    children: list[Node] = field(default_factory=list)


class Source(HTMLParser):
    """Elements and texts of a page with their offsets; elements without an end tag end where their parent does."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.source, self.open, self.nodes = source, [], []
        self.texts: list[tuple[int, int, tuple[Node, ...]]] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.gone: list[tuple[int, int]] = []
        self.feed(source)
        self.close()
        self._shut(0, len(source), len(source))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, level: int, end: int, stop: int) -> None:
        for i in range(len(self.open) - 1, level - 1, -1):
            node = self.open[i]
            node.end, node.stop = (end, stop) if i == level else (end, end)
        del self.open[level:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        start = self._at()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in ENDS.get(tag, ()):
                self._shut(i, start, start)
                break
            if self.open[i].tag in ("ul", "ol", "table", "div", "section", "article"):
                break
        node = Node(tag, {k: v or "" for k, v in attrs}, start, start + len(self.get_starttag_text() or ""), parents=tuple(self.open))
        for p in self.open:
            p.children.append(node)
        self.nodes.append(node)
        if tag in VOID:
            node.end = node.stop = node.inner
        else:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut(len(self.open) - 1, self.nodes[-1].inner, self.nodes[-1].inner)

    def handle_endtag(self, tag: str) -> None:
        at = self._at()
        level = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), None)
        if level is not None:
            close = self.source.find(">", at)
            self._shut(level, at, close + 1 if close >= 0 else len(self.source))

    def handle_data(self, data: str) -> None:
        at = self._at()
        self.texts.append((at, at + len(data), tuple(self.open)))

    def _reference(self, name: str) -> None:
        at = self._at()
        found = re.compile(r"&#?[0-9A-Za-z]+;?").match(self.source, at)
        self.texts.append((at, found.end() if found else at + 1, tuple(self.open)))

    handle_entityref = handle_charref = _reference

    def text(self, node: Node) -> str:
        own = [(a, b) for a, b, around in self.texts if node.inner <= a and b <= node.end and not any(n.tag in HIDDEN for n in around)]
        parts, last = [], None
        for a, b in own:
            piece = entities.unescape(self.source[a:b])
            if last == a and parts:
                parts[-1] += piece
            else:
                parts.append(piece)
            last = b
        return squeeze(parts)

    def kept(self, at: int) -> bool:
        return not any(a <= at < b for a, b in self.gone)


Edit = tuple[int, int, str]


def internal_rows(page: Source, row: dict[str, Any]) -> list[Edit]:
    """Rows, items and paragraphs of the pipeline's own labels go, and headings that are one."""
    out = []
    for node in page.nodes:
        if node.tag == "tr":
            cells = [c for c in node.children if c.tag in ("td", "th")]
            gone = bool(cells) and bool(INTERNAL.search(page.text(cells[0])))
        elif node.tag in ("li", "p"):
            text = page.text(node)
            gone = 0 < len(text) <= MOST_INTERNAL and bool(INTERNAL.search(text))
        elif node.tag in ("h2", "h3"):
            gone = bool(INTERNAL.fullmatch(page.text(node).rstrip(":：- ")))
        else:
            continue
        if gone:
            out.append((node.start, node.stop, ""))
    return out


def empty_rows(page: Source, row: dict[str, Any]) -> list[Edit]:
    """Rows of two or more cells whose last one says nothing go."""
    out = []
    for node in page.nodes:
        if node.tag == "tr" and len(cells := [c for c in node.children if c.tag in ("td", "th")]) > 1 and page.text(cells[-1]).casefold() in EMPTY_VALUES:
            out.append((node.start, node.stop, ""))
    return out


def _key(url: str) -> str:
    return re.sub(r"#.*$", "", entities.unescape(url).strip()).rstrip("/")


def _tag(attrs: dict[str, str]) -> str:
    return "<a" + "".join(f' {k}="{entities.escape(v)}"' for k, v in attrs.items()) + ">"


def action_links(page: Source, row: dict[str, Any]) -> list[Edit]:
    """The first link to each address of ``links`` (kind, label, url) is marked as what it leads to; those that no link leads to are added as boxes."""
    specs = {_key(x["url"]): x for x in reversed(row.get("links") or []) if (x["url"] or "").strip()}
    out: list[Edit] = []
    styled = set()
    for node in page.nodes:
        key = _key(node.attrs.get("href", "")) if node.tag == "a" else ""
        if key not in specs or key in styled or not page.kept(node.start):
            continue
        styled.add(key)
        kind = specs[key]["kind"]
        classes = dict.fromkeys([*node.attrs.get("class", "").split(), *CLASSES[kind]])
        attrs = node.attrs | {"target": "_blank", "rel": REL, "class": " ".join(classes)} | ({} if kind == "detail" else {"role": "button"})
        out.append((node.start, node.inner, _tag(attrs)))
    for spec in row.get("links") or []:
        key = _key(spec["url"] or "")
        if key in specs and key not in styled:
            styled.add(key)
            attrs = {"class": " ".join(CLASSES[spec["kind"]]), "href": spec["url"].strip(), "target": "_blank", "rel": REL}
            link = f"{_tag(attrs)}{entities.escape(spec['label'] or '')}</a>"
            out.append((len(page.source), len(page.source), f"<p>{link}</p>" if spec["kind"] == "detail" else f'<div class="actionBox">{link}</div>'))
    return out


def hub_link(page: Source, row: dict[str, Any]) -> list[Edit]:
    """One link to the hub: around the first of its words in a paragraph, an item or a cell, or else in a paragraph at the end."""
    hub = (row.get("hub") or "").strip()
    if not hub or hub in page.source:
        return []
    tag = _tag({"href": hub})
    for a, b, around in page.texts:
        inside = any(n.tag in ("p", "li", "td") for n in around) and not any(n.tag == "a" or n.tag in HIDDEN for n in around)
        if inside and page.kept(a) and (found := HUB_WORDS.search(page.source, a, b)):
            return [(found.start(), found.end(), f"{tag}{found[0]}</a>")]
    return [(len(page.source), len(page.source), f"<p>{HUB_TEXT}{tag}{HUB_LABEL}</a>.</p>")]


def page_images(page: Source, row: dict[str, Any]) -> list[Edit]:
    """Images of a document's pages (url, alt) that the page does not show yet, at its end."""
    shown = {_key(n.attrs.get("src", "")) for n in page.nodes if n.tag == "img"}
    new = {k: x for x in reversed(row.get("images") or []) if (k := _key(x["url"] or "")) and k not in shown}
    figures = [f'<figure><img src="{entities.escape(x["url"].strip())}" alt="{entities.escape(x["alt"] or "")}"></figure>' for x in reversed(new.values())]
    return [(len(page.source), len(page.source), "".join(figures))] if figures else []


REMOVERS = (internal_rows, empty_rows)
REWRITERS = (*REMOVERS, action_links, hub_link, page_images)


def applied(source: str, edits: list[Edit]) -> str:
    """The source with all edits; those within a wider one are dropped, those that start at one place keep their order."""
    out, at = [], 0
    for start, stop, text in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= at:
            out += [source[at:start], text]
            at = stop
    return "".join(out) + source[at:]


def rewrite(source: str | None, row: dict[str, Any], rewriters: tuple = REWRITERS) -> str | None:
    """The page after these rewriters, in whatever order they are given; a null page stays null."""
    if source is None:
        return None
    page = Source(source)
    removed = [e for r in REMOVERS if r in rewriters for e in r(page, row)]
    page.gone = [(a, b) for a, b, _ in removed]
    others = [e for r in REWRITERS if r in rewriters and r not in REMOVERS for e in r(page, row)]
    return applied(source, [*removed, *others])


def rewritten(df: DataFrame, html: str, links: str, images: str, hub: str) -> DataFrame:
    """``df`` with the column ``html`` rewritten.  ``links``: array of (kind, label, url), ``images``: array of (url, alt), ``hub``: address of the hub."""
    places = {name: df.columns.index(c) for name, c in (("html", html), ("links", links), ("images", images), ("hub", hub))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, places["html"])):
            columns = {name: batch.column(i).to_pylist() for name, i in places.items()}
            found = [rewrite(h, {"links": a, "images": b, "hub": c}) for h, a, b, c in zip(*columns.values(), strict=True)]
            arrays = [pa.array(found, pa.string()) if i == places["html"] else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.withColumn(html, F.col(html).cast("string")).mapInArrow(run, df.withColumn(html, F.col(html).cast("string")).schema)
