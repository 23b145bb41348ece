"""Fields of a page by layers with provenance: structured data first, then labels in its text, its row, its source's defaults.

Each layer gives candidates ``(id, field, value, origin, confidence)``; ``merged`` takes, for each page and field, the one of the first layer that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.api import at

#: Origins, the first layer first.
LAYERS = ("structured", "label", "row", "source")
CONFIDENCE = {"structured": "high", "label": "high", "row": "medium", "source": "low"}


def _long(df: DataFrame, id_col: str, layers: dict[str, dict[str, Column]]) -> DataFrame:
    """A row for each layer's field that is not blank."""
    pair = lambda k, v, origin: F.struct(F.lit(k).alias("field"), texts.clean(v.cast("string")).alias("value"), F.lit(origin).alias("origin"), F.lit(CONFIDENCE[origin]).alias("confidence"))
    pairs = F.array(*(pair(k, v, origin) for origin, fields in layers.items() for k, v in fields.items()))
    return df.select(F.col(id_col), F.explode(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")).alias("p")).select(id_col, "p.*")


def _one_or_many(node: Column, key: str) -> Column:
    """A field that may be one value or a list of them, as an array of variants."""
    many = F.try_variant_get(node, f"$['{key}']", "array<variant>")
    one = F.try_variant_get(node, f"$['{key}']", "variant")
    return F.filter(F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<variant>")), lambda v: v.isNotNull())


def _plain(node: Column) -> Column:
    """A variant as text unless it is an object or a list."""
    return F.when(F.schema_of_variant(node).rlike("^(?:OBJECT|ARRAY)"), F.lit(None)).otherwise(F.try_variant_get(node, "$", "string"))


def posting_fields(node: Column) -> dict[str, Column]:
    """Fields of a posting's structured data."""
    org = F.get(_one_or_many(node, "hiringOrganization"), F.lit(0))
    addresses = F.transform(_one_or_many(node, "jobLocation"), lambda v: F.try_variant_get(v, "$.address", "variant"))
    place = F.transform(addresses, lambda a: F.concat_ws(", ", F.nullif(F.trim(at(a, "addressLocality")), F.lit("")), F.nullif(F.trim(at(a, "addressRegion")), F.lit(""))))
    country = F.transform(addresses, lambda a: F.coalesce(at(a, "addressCountry", "name"), at(a, "addressCountry", "@id"), _plain(F.try_variant_get(a, "$.addressCountry", "variant"))))
    first_of = lambda xs: F.get(F.filter(xs, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(0))
    pay = F.try_variant_get(node, "$.baseSalary", "variant")
    least, most, unit = F.coalesce(at(pay, "value", "value"), at(pay, "value", "minValue")), at(pay, "value", "maxValue"), at(pay, "value", "unitText")
    amount = F.when(most.isNotNull() & (most != least), F.concat_ws("-", least, most)).otherwise(F.coalesce(least, _plain(F.try_variant_get(pay, "$.value", "variant"))))
    ident = F.get(_one_or_many(node, "identifier"), F.lit(0))
    logo = F.coalesce(at(org, "logo", "url"), at(org, "logo", "contentUrl"), _plain(F.try_variant_get(org, "$.logo", "variant")))
    until = at(node, "validThrough")
    # an horizon of decades stands for none
    open_ended = F.coalesce(F.regexp_extract(until, r"^(\d{4})", 1).try_cast("int") - F.regexp_extract(at(node, "datePosted"), r"^(\d{4})", 1).try_cast("int") >= 10, F.lit(False))
    return {
        "title": at(node, "title"),
        "company": at(org, "name"),
        "location": F.array_join(F.array_distinct(F.filter(place, lambda x: x != "")), " / "),
        "country": first_of(country),
        "contract": F.array_join(F.transform(_one_or_many(node, "employmentType"), _plain), ", "),
        "salary": F.coalesce(F.nullif(F.concat_ws(" ", amount, at(pay, "currency"), unit), F.lit("")), _plain(pay)),
        "deadline": F.when(~open_ended, until),
        "published": at(node, "datePosted"),
        "reference": F.coalesce(at(ident, "value"), at(ident, "name"), _plain(ident)),
        "logo": logo,
        "remote": F.when(F.upper(at(node, "jobLocationType")) == "TELECOMMUTE", F.lit("true")),
    }


def from_nodes(pages: DataFrame, id_col: str, nodes: str, kind: str = "JobPosting") -> DataFrame:
    """Candidates of the first node of a kind of ``array<struct<type, json>>``, as ``html.parsed`` gives it."""
    return _long(pages.select(id_col, _own(nodes, kind).alias("_node")).filter("_node is not null"), id_col, {"structured": posting_fields(F.col("_node"))})


def _own(nodes: str, kind: str) -> Column:
    return F.try_parse_json(F.get(F.filter(nodes, lambda n: F.array_contains(F.split(n["type"], ","), kind)), F.lit(0))["json"])


def from_labels(pages: DataFrame, id_col: str, blocks: str, labels: dict[str, str]) -> DataFrame:
    """Candidates of blocks ``label: value``: a field's label is a regex for the whole of what stands before the colon; the first block wins."""
    return _long(pages.select(id_col, blocks), id_col, {"label": _labelled(blocks, labels)})


def _labelled(blocks: str, labels: dict[str, str]) -> dict[str, Column]:
    text = F.transform(blocks, lambda b: b["text"])

    def value(pattern: str) -> Column:
        whole = rf"(?i)^\s*(?:{pattern})\s*[:：]\s*(\S.*)$"
        return F.regexp_extract(F.get(F.filter(text, lambda t: t.rlike(whole)), F.lit(0)), whole, 1)

    return {f: value(p) for f, p in labels.items()}


def from_page(pages: DataFrame, id_col: str, nodes: str, blocks: str, labels: dict[str, str], kind: str = "JobPosting") -> DataFrame:
    """Candidates of ``from_nodes`` and ``from_labels`` in one pass, so that pages are parsed once."""
    read = pages.select(id_col, _own(nodes, kind).alias("_node"), blocks)
    return _long(read, id_col, {"structured": posting_fields(F.col("_node")), "label": _labelled(blocks, labels)})


def from_row(rows: DataFrame, id_col: str, fields: dict[str, Column], origin: str = "row") -> DataFrame:
    """Candidates of columns of the row that led to the page, or (``origin="source"``) of its source."""
    return _long(rows, id_col, {origin: fields})


def merged(id_col: str, *layers: DataFrame) -> DataFrame:
    """``(id, field, value, origin, confidence)``: of each page's field the value of the first layer that has it."""
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("origin"))
    best = F.min_by(F.struct("value", "origin", "confidence"), F.struct(rank, "value"))
    return every.groupBy(id_col, "field").agg(best.alias("b")).select(id_col, "field", "b.*")


def wide(facts: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row for each page: a column for each field, and the map of their origins."""
    picked = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return facts.groupBy(id_col).agg(*picked, F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "origin")))).alias("origins"))


def provenance(value: Column, official: Column, table: Column, document: Column, detail: Column, hints: tuple[str, ...] = ()) -> Column:
    """``(source, confidence)`` of a value: the first of table, document and page text that has it (with ``hints``, in a text that has one of them too)."""
    want = texts.clean(F.lower(value))

    def has(text: Column) -> Column:
        own = texts.clean(F.lower(F.coalesce(text, F.lit(""))))
        there = F.contains(own, want) | (F.size(F.array_intersect(texts.dates(own), texts.dates(want))) > 0)
        hinted = F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(own, F.lower(h))) if hints else F.lit(True)
        return F.coalesce(there & hinted, F.lit(False))

    source = F.when(F.coalesce(want, F.lit("")) == "", "missing").when(has(table), "source_table").when(has(document), "official_pdf").when(has(detail), "official_detail_page").otherwise("extracted_field")
    sure = F.when(source == "missing", "heuristic").when((source != "extracted_field") & F.coalesce(official, F.lit(False)), "high").otherwise("medium")
    return F.struct(source.alias("source"), sure.alias("confidence"))
