"""JSON: repair of fenced replies, canonical signatures, structured postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ladders

REQUIRED = ("title", "company", "posted")


def unfenced(text: Column) -> Column:
    """Without code fences around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def repaired(text: Column) -> Column:
    """The JSON object of a reply as a variant: the whole, else from the first brace to the last; null if neither parses."""
    whole = unfenced(text)
    return F.coalesce(F.try_parse_json(whole), F.try_parse_json(F.regexp_extract(whole, r"(?s)(\{.*\})", 1)))


def missing_keys(text: Column, required: tuple[str, ...]) -> Column:
    """Required keys that a reply lacks, or has blank."""
    body = F.regexp_extract(unfenced(text), r"(?s)(\{.*\})", 1)
    blank = lambda k: F.coalesce(F.trim(F.get_json_object(body, f"$.{k}")), F.lit("")) == ""
    return F.array_compact(F.array(*(F.when(blank(k), F.lit(k)) for k in required)))


def signature(fields: dict[str, Column], length: int = 64) -> Column:
    """Hash of the fields' canonical JSON: keys in order, nulls left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items())))), 256), 1, length)


def posting(title: Column, company: Column, posted: Column, location: Column, deadline: Column, url: Column) -> Column:
    """A JobPosting document; empty members are left out."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    organisation = F.when(full(company).isNotNull(), F.struct(F.lit("Organization").alias("@type"), full(company).alias("name")))
    place = F.when(full(location).isNotNull(), F.struct(F.lit("Place").alias("@type"), F.struct(F.lit("PostalAddress").alias("@type"), full(location).alias("addressLocality")).alias("address")))
    members = {
        "@context": F.lit("https://schema.org"), "@type": F.lit("JobPosting"), "title": full(title), "hiringOrganization": organisation,
        "datePosted": full(posted), "validThrough": full(deadline), "jobLocation": place, "url": full(url),
    }
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())), {"ignoreNullFields": "true"})


def posting_errors(values: dict[str, Column], now: Column) -> Column:
    """What keeps a posting from being valid."""
    blank = lambda k: F.coalesce(F.trim(values[k]), F.lit("")) == ""
    due = F.try_to_date(values["deadline"])
    return ladders.reasons(*((blank(k), f"missing_{k}") for k in REQUIRED), (due < F.to_date(now), "expired"), (blank("location"), "missing_location"))
