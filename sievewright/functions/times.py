"""Event-time expressions.  Every one takes ``now``; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Freshness limits in hours by kind of opportunity.
FRESH_HOURS = {"job": 24, "internship": 168, "apprenticeship": 168, "scholarship": 720, "training": 720}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.floor((micros(later) - micros(earlier)) / 1_000_000).cast("long")


def parse(text: Column) -> Column:
    """ISO times (no zone: UTC), dates, ``d/m/y`` and ``d-m-y``; junk is null."""
    head = F.substring(F.trim(text), 1, 10)
    return F.coalesce(F.try_to_timestamp(F.trim(text)), *(F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")))


def limit_hours(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in FRESH_HOURS.items() for x in kv))[kind], F.lit(FRESH_HOURS["job"]))


def freshness(published: Column, date_only: Column, kind: Column, now: Column, discovered: Column | None = None) -> Column:
    """``(known, fresh, future, age_hours)``: a time is fresh up to its limit, a day while its whole age is below it."""
    at = F.coalesce(published, discovered) if discovered is not None else published
    age = (micros(now) - micros(at)) / 3_600_000_000
    days = F.datediff(now, at) * 24
    limit = limit_hours(kind)
    fresh = F.when(date_only, (days >= 0) & (days < limit)).otherwise((age >= 0) & (age <= limit))
    future = F.when(date_only, days < 0).otherwise(age < 0)
    return F.struct(at.isNotNull().alias("known"), F.coalesce(fresh, F.lit(False)).alias("fresh"), F.coalesce(future, F.lit(False)).alias("future"), age.alias("age_hours"))


def is_placeholder_deadline(deadline: Column, now: Column) -> Column:
    return F.to_date(deadline) > F.date_add(F.to_date(now), 366 * 5)


def backoff(base: float, count: Column, doublings: int, cap: float) -> Column:
    """``base * 2^min(count - 1, doublings)``, at most ``cap``."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), F.least(count - 1, F.lit(doublings))))
