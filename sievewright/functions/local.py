"""Local time: days, hours and deadlines in the readers' zone; dates of postings and of claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import texts, times

# The zone in which days and deadlines count.
ZONE = "Africa/Casablanca"
DAY_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def local(ts: Column, zone: str = ZONE) -> Column:
    """A time's wall clock in a zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def day_key(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM-dd")


def end_of_day(day: Column, zone: str = ZONE) -> Column:
    """The last microsecond of a local day, as a time."""
    return F.to_utc_timestamp(F.concat(day, F.lit(" 23:59:59.999999")).cast("timestamp"), zone)


def deadline_time(text: Column, now: Column, zone: str = ZONE) -> Column:
    """A deadline's time: a date alone ends with its local day; one beyond five years is a placeholder and none."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    at = F.when(raw.rlike(DAY_FORM) & F.try_to_date(raw, "yyyy-MM-dd").isNotNull(), end_of_day(raw, zone)).otherwise(F.when(~raw.rlike(DAY_FORM), times.parse(raw)))
    return F.when(~F.coalesce(times.is_placeholder_deadline(F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"), now), F.lit(False)), at)


def schema_date(text: Column) -> Column:
    """A date or an ISO time as it is; else a date at the text's start; else empty."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    head = F.regexp_extract(raw, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(raw.rlike(DAY_FORM) | (F.try_to_timestamp(raw).isNotNull() & (head != "")), raw).otherwise(head)


def date_posted(published: Column, official: Column, discovered: Column) -> Column:
    """The publication date; for official rows without one the day of discovery."""
    seen = F.regexp_extract(schema_date(discovered), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(F.trim(F.coalesce(published, F.lit(""))) != "", schema_date(published)).when(F.coalesce(official, F.lit(False)), seen).otherwise("")


def deadline_claims(text: Column, cues: str = texts.DEADLINE_LABELS) -> Column:
    """For each sentence with a cue the first date after it; distinct, in order."""
    sentences = F.split(texts.folded(F.regexp_replace(text, r"[\n.!؟؛]+", "   ")), " ")
    claimed = F.transform(sentences, lambda s: texts.first_date(F.regexp_extract(s, rf"(?:{cues})(.*)$", 1)))
    return F.array_distinct(F.array_compact(claimed))


def published_time(json_ld: Column, meta: Column, time_tag: Column) -> Column:
    """A page's publication time: structured data, then meta, then its first time element."""
    return F.coalesce(*(times.parse(F.nullif(F.trim(c), F.lit(""))) for c in (json_ld, meta, time_tag)))
