"""Rows of the providers' JSON replies, with DataFrame functions alone: declared fields for replies of known shape, a
recursive walk for those of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, texts
from ..operators import tables

#: Columns of a listing's record.
RECORD = ("title", "url", "provider", "reference", "published_at", "published_label", "location", "country", "company")


def _record(rows: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(*keep, *(fields.get(name, none).alias(name) for name in RECORD))


def workday(replies: DataFrame, reply: str, listing_url: Column) -> DataFrame:
    """Records of ``jobPostings``: those with a title and a path; the first bullet is the reference."""
    keep = [c for c in replies.columns if c != reply]
    job = "jobPostings array<struct<title: string, externalPath: string, bulletFields: string, postedOn: string>>"
    rows = replies.withColumn("_listing", listing_url).withColumn("_j", F.explode(F.from_json(reply, job)["jobPostings"]))
    path = F.trim("_j.externalPath")
    bullets = F.from_json("_j.bulletFields", "array<string>")  # null where it is no array
    shaped = _record(
        rows, keep, title=texts.clean(F.col("_j.title")), url=F.concat(F.col("_listing"), F.when(F.startswith(path, F.lit("/")), F.lit("")).otherwise("/"), path),
        provider=F.lit("workday"), reference=F.coalesce(F.get(bullets, F.lit(0)), F.lit("")), published_label=F.trim(F.coalesce("_j.postedOn", F.lit(""))),
    )
    return shaped.filter("coalesce(title, '') <> '' and url is not null and url not like '%/'")


def csod(replies: DataFrame, reply: str, origin: Column, site: Column, corp: Column) -> DataFrame:
    """Records of ``data.requisitions``: titles without markup, days written month first."""
    keep = [c for c in replies.columns if c != reply]
    job = "data struct<requisitions: array<struct<requisitionId: string, displayJobTitle: string, postingEffectiveDate: string>>>"
    rows = replies.withColumns({"_o": origin, "_s": site, "_c": corp}).withColumn("_j", F.explode(F.from_json(reply, job)["data"]["requisitions"]))
    ident = F.trim("_j.requisitionId")
    url = F.concat(F.col("_o"), F.lit("/ux/ats/careersite/"), F.col("_s"), F.lit("/home/requisition/"), ident, F.lit("?c="), F.col("_c"))
    title = texts.clean(F.regexp_replace("_j.displayJobTitle", "<[^>]+>", " "))
    day = F.when(F.trim("_j.postingEffectiveDate").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.date_format(F.try_to_timestamp(F.trim("_j.postingEffectiveDate"), F.lit("M/d/yyyy")), "yyyy-MM-dd"))
    return _record(rows, keep, title=title, url=url, provider=F.lit("csod"), reference=ident, published_at=day).filter("coalesce(title, '') <> '' and coalesce(reference, '') <> ''")


def smartrecruiters(replies: DataFrame, reply: str, listing_url: Column) -> DataFrame:
    """Records of ``content`` of numeric ids; of the country that the listing's address asks for, if it asks."""
    keep = [c for c in replies.columns if c != reply]
    job = "content array<struct<id: string, name: string, releasedDate: string, location: struct<city: string, country: string>, company: struct<name: string>>>"
    rows = replies.withColumn("_l", listing_url).withColumn("_j", F.explode(F.from_json(reply, job)["content"]))
    company = F.regexp_extract("_l", r"^https?://api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9_-]+)/postings/?(?:\?|$)", 1)
    country = F.lower(F.regexp_extract("_l", r"[?&]country=([^&#]*)", 1))
    own = (country == "") | (F.lower(F.coalesce("_j.location.country", F.lit(""))) == country)
    rows = rows.filter(own & (company != "") & F.col("_j.id").rlike("^[0-9]+$") & (F.trim(F.coalesce("_j.name", F.lit(""))) != ""))
    url = F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/"), company, F.lit("/postings/"), F.col("_j.id"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return _record(
        rows, keep, title=F.col("_j.name"), url=url, provider=F.lit("smartrecruiters"), reference=F.col("_j.id"), published_at=empty("_j.releasedDate"),
        location=empty("_j.location.city"), country=empty("_j.location.country"), company=empty("_j.company.name"),
    )


_NODE = "array<struct<path: string, node: variant>>"


def _children(nodes: Column) -> Column:
    """The values one level down: of objects by key, of arrays by position."""
    none = F.array().cast(_NODE)

    def of(parent: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(parent["node"], "$", "map<string, variant>"))
        by_key = F.transform(entries, lambda e: F.struct(F.concat_ws(".", F.nullif(parent["path"], F.lit("")), e["key"]).alias("path"), e["value"].alias("node")))
        items = F.try_variant_get(parent["node"], "$", "array<variant>")
        by_place = F.transform(items, lambda v, i: F.struct(F.concat(parent["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("node")))
        return F.concat(F.coalesce(by_key, none), F.coalesce(by_place, none))

    return F.filter(F.flatten(F.transform(nodes, of)), lambda c: c["node"].isNotNull() & _kind(c["node"]).isin("OBJECT", "ARRAY"))


def _kind(node: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def nodes(df: DataFrame, column: str, depth: int = 12) -> DataFrame:
    """``df`` with one row for each object at any depth of the JSON text ``column``, instead of it: ``path`` (keys joined by dots,
    array positions in brackets) and ``node`` (variant).

    The walk is unrolled: a projection takes all values of one level to those of the next, so it is a narrow map without Python.  JSON of
    more than ``depth`` levels raises, so nothing is left out unseen.  A row without JSON, or of a plain value, gives none.
    """
    keep = [c for c in df.columns if c != column]
    json = F.try_parse_json(column)
    level = df.select(*keep, F.when(json.isNotNull(), F.array(F.struct(F.lit("").alias("path"), json.alias("node")))).otherwise(F.array()).cast(_NODE).alias("_0"))
    for d in range(1, depth + 1):
        level = level.withColumn(f"_{d}", _children(F.col(f"_{d - 1}")))
    deeper = F.when(F.size(_children(F.col(f"_{depth}"))) > 0, F.raise_error(F.lit(f"JSON of more than {depth} levels")).cast(_NODE)).otherwise(F.array().cast(_NODE))
    every = F.filter(F.concat(*(F.col(f"_{d}") for d in range(depth + 1)), deeper), lambda c: _kind(c["node"]) == "OBJECT")
    return level.select(*keep, F.explode(every).alias("_n")).select(*keep, "_n.path", "_n.node")


def at(node: Column, *keys: str) -> Column:
    """A field of a variant as text, in plain spelling; null where it is not there or null."""
    return F.try_variant_get(node, "$" + "".join(f"['{k}']" for k in keys), "string")


def phenom(pages: DataFrame, id_col: str, page: str, country: str = "MOROCCO") -> DataFrame:
    """Records of a page's state object: objects at any depth with a job's id and title, of a country, with an address to apply at;
    of one sequence number that on the least path."""
    state = numbers.json_after(F.col(page), "phApp.ddo =")
    found = nodes(pages.select(id_col, state.alias("_state")), "_state")
    text = lambda *k: F.trim(F.coalesce(at(F.col("node"), *k), F.lit("")))
    named = found.withColumns({"_title": texts.clean(text("title")), "_job": text("jobId")}).filter("_title <> '' and _job <> ''")
    folded = country.lower()
    own = (F.lower(text("country")) == folded) | F.contains(F.lower(text("location")), F.lit(folded)) | F.contains(F.lower(text("cityStateCountry")), F.lit(folded))
    one = named.filter(own).withColumn("_seq", F.coalesce(F.nullif(text("jobSeqNo"), F.lit("")), "_job"))
    one = tables.keep_first(one, [id_col, "_seq"], "path")
    first = lambda *names: F.coalesce(*(F.nullif(text(n), F.lit("")) for n in names), F.lit(""))
    return _record(
        one, [id_col], title=F.col("_title"), url=text("applyUrl"), provider=F.lit("phenom"), reference=F.col("_job"), published_at=first("postedDate", "dateCreated"),
        location=first("location", "cityStateCountry"), country=F.lit("MA"), company=text("company"),
    ).filter("url <> ''")
