"""HTML documents: text, title, headed blocks, tables, links and structured data by a streaming parser.

Broken markup needs a parser, so this is a narrow Arrow map; one page is held at a time.
A null page has an empty text and no blocks.  Tables have budgets by page; what is beyond them is left out, never merged
into what is within, and ``truncated`` says so.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4"}
BREAKS = HEADINGS | {"p", "div", "li", "tr", "td", "th", "br", "table", "ul", "ol", "section", "article", "main", "blockquote", "nav", "header", "footer", "aside", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
REGIONS = {"nav", "header", "footer", "aside", "form", "main", "article", "section"}
# What is around a text and not of it, and what marks its container.
AROUND = {"nav", "header", "footer", "aside", "form"}
NOISE_HINTS = ("sidebar", "cookie", "newsletter", "advert", "share", "related", "comment", "breadcrumb", "social", "menu")
CONTAINERS = {"article", "main"}
CONTAINER_HINTS = ("article-body", "entry-content", "post-content", "job-description", "article-content")
# Budgets of what is taken of tables, by page; least characters of a part of a text, and of a heading; size of a print.
MOST_TABLES, MOST_ROWS, MOST_CELLS, MOST_CHARS = 12, 120, 16, 24_000
LEAST, LEAST_HEADING, PRINT = 30, 18, 180
_BLOCK = "struct<heading: string, text: string, region: string, kind: string>"
SCHEMA = (
    f"id bigint, title string, text string, blocks array<{_BLOCK}>, tables array<array<array<string>>>, links array<struct<href: string, label: string>>, "
    "truncated boolean, body string, description string, meta_time string, time_tag string, nodes array<struct<type: string, json: string>>"
)
_STRING = pa.string()
_TYPES = [
    pa.int64(), _STRING, _STRING,
    pa.list_(pa.struct([("heading", _STRING), ("text", _STRING), ("region", _STRING), ("kind", _STRING)])),
    pa.list_(pa.list_(pa.list_(_STRING))),
    pa.list_(pa.struct([("href", _STRING), ("label", _STRING)])),
    pa.bool_(), _STRING, _STRING, _STRING, _STRING,
    pa.list_(pa.struct([("type", _STRING), ("json", _STRING)])),
]


def squeeze(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def ld_nodes(value: Any) -> Iterator[dict]:
    """All nodes of structured data, outer ones first, wherever they are nested."""
    if isinstance(value, list):
        for v in value:
            yield from ld_nodes(v)
    elif isinstance(value, dict):
        if "@type" in value:
            yield value
        for v in value.values():
            if isinstance(v, (dict, list)):
                yield from ld_nodes(v)


class Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.all: list[str] = []
        self.title: list[str] = []
        self.block: list[str] = []
        self.heading = ""
        self.blocks: list[dict] = []
        self.tables: list[list[list[str]]] = []
        #: open tables, None for those that are left out, with the row that is open in each
        self.open: list[tuple[list[list[str]] | None, list[list[str] | None]]] = []
        self.cell: list[str] | None = None
        self.cells = self.chars = 0
        self.truncated = False
        self.links: list[dict] = []
        self.anchor: tuple[str, list[str]] | None = None
        self.inside: list[str] = []
        #: open elements: tag, whether it is around the text, its container
        self.path: list[tuple[str, bool, int | None]] = []
        self.containers: list[list[tuple[str, bool]]] = [[]]
        self.meta: dict[str, str] = {}
        self.time_tag = ""
        self.script: list[str] | None = None
        self.scripts: list[str] = []

    def around(self) -> bool:
        return any(x for _, x, _ in self.path)

    def close_block(self, heading: bool = False) -> None:
        if text := squeeze(self.block):
            if not heading:
                region = next((t for t, *_ in reversed(self.path) if t in REGIONS), "body")
                self.blocks.append({"heading": self.heading, "text": text, "region": region, "kind": "text"})
            if not self.around():
                for at in {0, *(c for *_, c in self.path if c is not None)}:
                    self.containers[at].append((text, heading))
        self.block = []

    def close_cell(self) -> None:
        if self.cell is not None and self.open and self.open[-1][1] and (row := self.open[-1][1][0]) is not None and (text := squeeze(self.cell)):
            row.append(text)
        self.cell = None

    def close_row(self) -> None:
        self.close_cell()
        if not self.open:
            return
        rows, row = self.open[-1]
        if rows is not None and row and row[0]:
            size = sum(map(len, row[0])) + 3 * (len(row[0]) - 1)
            if self.chars + size > MOST_CHARS:
                self.truncated, self.chars = True, MOST_CHARS
            else:
                rows.append(row[0])
                self.chars += size
        row.clear()

    def start_table(self) -> None:
        full = len(self.tables) >= MOST_TABLES or self.chars >= MOST_CHARS
        self.truncated |= full and not self.around()
        rows: list[list[str]] | None = None if full or self.around() else []
        if rows is not None:
            self.tables.append(rows)
        self.open.append((rows, []))

    def start_row(self) -> None:
        self.close_row()
        if self.open and (rows := self.open[-1][0]) is not None:
            full = len(rows) >= MOST_ROWS or self.chars >= MOST_CHARS
            self.truncated |= full
            self.open[-1][1].append(None if full else [])
            self.cells = 0

    def start_cell(self) -> None:
        self.close_cell()
        self.cells += 1
        if self.open and self.open[-1][1] and self.cells <= MOST_CELLS:
            self.cell = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self.close_block()
        given = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := given.get("name") or given.get("property")):
            self.meta.setdefault(name.lower(), given.get("content", ""))
        if tag in HIDDEN:
            self.hidden += 1
            self.script = [] if tag == "script" and given.get("type", "").strip().lower() == "application/ld+json" else None
        if tag == "time" and not self.time_tag:
            self.time_tag = given.get("datetime", "")
        if tag not in VOID:
            marks = " ".join(given.get(k, "") for k in ("class", "id", "role", "aria-label")).lower()
            noise = tag in AROUND or (tag not in ("html", "body") and any(h in marks for h in NOISE_HINTS))
            holds = tag in CONTAINERS or given.get("role") == "main" or any(h in marks for h in CONTAINER_HINTS)
            if holds:
                self.containers.append([])
            self.path.append((tag, noise, len(self.containers) - 1 if holds else None))
        if tag in HEADINGS or tag == "title":
            self.inside.append(tag)
        if tag == "table":
            self.start_table()
        elif tag == "tr":
            self.start_row()
        elif tag in ("td", "th"):
            self.start_cell()
        elif tag == "a" and (href := given.get("href")):
            self.anchor = (href, [])

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
            if self.script is not None:
                self.scripts.append("".join(self.script))
                self.script = None
        if tag in HEADINGS and self.inside[-1:] == [tag]:
            self.heading = squeeze(self.block)
            self.blocks += [{"heading": self.heading, "text": self.heading, "region": next((t for t, *_ in reversed(self.path) if t in REGIONS), "body"), "kind": tag}] if self.heading else []
            self.close_block(heading=True)
        if self.inside[-1:] == [tag]:
            self.inside.pop()
        if tag in BREAKS:
            self.close_block()
        if tag in ("td", "th"):
            self.close_cell()
        elif tag == "tr":
            self.close_row()
        elif tag == "table" and self.open:
            self.close_row()
            self.open.pop()
        if any(t == tag for t, *_ in self.path):
            while self.path.pop()[0] != tag:
                pass
        if tag == "a" and self.anchor:
            self.links.append({"href": self.anchor[0], "label": squeeze(self.anchor[1])})
            self.anchor = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.script is not None:
                self.script.append(data)
            return
        if self.inside[-1:] == ["title"]:
            self.title.append(data)
        else:
            self.block.append(data)
        self.all.append(data)
        if self.cell is not None:
            self.cell.append(data)
        if self.anchor:
            self.anchor[1].append(data)

    def body(self) -> str:
        """The parts of the container with the longest text, or of the whole page: long enough, each once."""
        best = max(range(len(self.containers)), key=lambda i: (i > 0, sum(len(t) for t, _ in self.containers[i])) if self.containers[i] else (False, 0))
        seen, kept = set(), []
        for text, heading in self.containers[best]:
            mark = re.sub(r"\W+", "", text.casefold())[:PRINT]
            if len(text) >= (LEAST_HEADING if heading else LEAST) and mark not in seen:
                seen.add(mark)
                kept.append(text)
        return " ".join(kept)

    def nodes(self) -> list[dict]:
        found = []
        for script in self.scripts:
            try:
                value = json.loads(script)
            except ValueError:
                continue
            for node in ld_nodes(value):
                kind = node["@type"]
                found.append({"type": ",".join(map(str, kind)) if isinstance(kind, list) else str(kind), "json": json.dumps(node, ensure_ascii=False, sort_keys=True)})
        return found


def parse(source: str | None) -> tuple:
    page = Page()
    page.feed(source or "")
    page.close()
    page.close_block()
    while page.open:
        page.close_row()
        page.open.pop()
    blocks = [b for b in page.blocks if b["kind"] == "text"]
    description = page.meta.get("description") or page.meta.get("og:description", "")
    published = page.meta.get("article:published_time") or page.meta.get("date", "")
    title = squeeze(page.title) or squeeze([page.meta.get("og:title", "")]) or next((b["text"] for b in page.blocks if b["kind"] == "h1"), "")
    return title, squeeze(page.all), blocks, [t for t in page.tables if t], page.links, page.truncated, page.body(), squeeze([description]), published.strip(), page.time_tag.strip(), page.nodes()


#: Pages of a slice of a batch, and characters after which it ends: what is parsed at a time.
SLICE, SLICE_CHARS = 256, 1 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``SLICE`` rows, fewer where their texts are long: a batch has up to 10,000 rows, and parsed pages take many times their size."""
    at = chars = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        chars += n or 0
        if chars >= SLICE_CHARS or i + 1 - at == SLICE:
            yield batch.slice(at, i + 1 - at)
            at, chars = i + 1, 0
    if at < batch.num_rows or not batch.num_rows:
        yield batch.slice(at)


def parsed(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """``(id_col, title, text, blocks, tables, links, truncated, body, description, meta_time, time_tag, nodes)`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in re.split(r", (?=[a-z_]+ (?:bigint|string|array|boolean))", SCHEMA)]
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [parse(source.as_py()) for source in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(_TYPES) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:], strict=True))], names=names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(html).alias("html")).mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


# Cell texts that say nothing.
EMPTY_VALUES = ("", "0", "0.0", "unknown", "none", "null", "غير محدد", "غير متوفر")


def without_empty_rows(html: Column) -> Column:
    """Generated markup without the table rows whose last of two or more cells says nothing."""
    cell = r"<t[hd]\b[^>]*>(?:(?!</?t[rhd]\b).)*</t[hd]>\s*"
    values = "|".join(re.escape(v).replace("\\ ", r"\s+") for v in EMPTY_VALUES)
    return F.regexp_replace(html, rf"(?is)<tr\b[^>]*>\s*(?:{cell})+<t[hd]\b[^>]*>\s*(?:{values})\s*</t[hd]>\s*</tr>", "")


def with_links(html: Column, links: Column, title: str) -> Column:
    """Markup with a list of the ``(href, label)`` links that it lacks at its end."""
    absent = F.filter(links, lambda x: ~F.contains(html, x["href"]))
    safe = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    items = F.transform(absent, lambda x: F.concat(F.lit('<li><a href="'), safe(x["href"]), F.lit('">'), safe(x["label"]), F.lit("</a></li>")))
    return F.when(F.size(absent) == 0, html).otherwise(F.concat(html, F.lit(f"<h2>{title}</h2><ul>"), F.array_join(items, ""), F.lit("</ul>")))
