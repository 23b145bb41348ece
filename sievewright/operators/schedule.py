"""Pacing and state: publication windows, slots of the week, status machines, discovery cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders, local, times


def window_status(now: Column, published_today: Column, cap: Column, last_publish: Column, start_hour: int, end_hour: int, minutes: int, zone: str = local.ZONE) -> Column:
    """``(allowed_now, reasons, next_allowed)``: under the day's cap, in the active hours, far enough from the last; local wall clock."""
    here = local.local(now, zone)
    today = F.date_trunc("day", here)
    opens = F.expr(f"interval {start_hour} hours")
    tomorrow = today + F.expr("interval 1 day") + opens
    full = published_today >= cap
    outside = (F.hour(here) < start_hour) | (F.hour(here) >= end_hour)
    after = local.local(last_publish, zone) + F.expr(f"interval {minutes} minutes")
    near = F.coalesce(after > here, F.lit(False))
    reasons = ladders.reasons((full, "daily_cap"), (outside, "inactive_hours"), (near, "spacing"))
    opening = F.when(F.hour(here) >= end_hour, tomorrow).otherwise(today + opens)
    following = F.greatest(here, F.when(full, tomorrow), F.when(outside, opening), F.when(near, after))
    return F.struct((F.size(reasons) == 0).alias("allowed_now"), reasons.alias("reasons"), following.alias("next_allowed"))


def next_slot(times_: DataFrame, slots: DataFrame, id_col: str, at: str, span: int = 50) -> DataFrame:
    """For each local time the slot of ``slots (weekday, minute)`` it falls in, as minutes of its week, and the start of the next one.

    Slots repeat weekly; Monday is 0.  A week has few slots, so they are gathered in one row that each time reads.
    """
    starts = slots.agg(F.array_sort(F.collect_set((F.col("weekday") * 1440 + F.col("minute")).cast("long"))).alias("_starts"))  # at most 10,080
    rows = times_.join(F.broadcast(starts))
    week = F.date_trunc("week", at)
    minute = F.floor((times.micros(F.col(at)) - times.micros(week)) / 60_000_000)
    inside = F.array_max(F.filter("_starts", lambda s: (s <= F.col("_m")) & (F.col("_m") < s + span)))
    coming = F.coalesce(F.array_min(F.filter("_starts", lambda s: s > F.col("_m"))), F.array_min("_starts") + 7 * 1440)
    found = rows.withColumn("_m", minute)
    return found.select(id_col, inside.alias("slot"), F.unix_seconds(week + F.make_dt_interval(F.lit(0), F.lit(0), coming.cast("int"))).alias("next_start"))


def following(df: DataFrame, slot: str, most: int, name: str) -> DataFrame:
    """Add ``name``: the next slot that has a row, the first one after the last; a week has at most ``most`` slots, which are gathered."""
    all_ = df.agg(F.array_sort(F.collect_set(slot)).alias("_all"))
    later = F.filter("_all", lambda s: s > F.col(slot))
    return df.filter(F.col(slot) < most).join(F.broadcast(all_)).withColumn(name, F.coalesce(F.array_min(later), F.array_min("_all"))).drop("_all")


def local_counters(events: DataFrame, at: str, by: list[str], zone: str = local.ZONE) -> DataFrame:
    """Events of each local day."""
    return events.groupBy(local.day_key(F.col(at), zone).alias("day"), *by).agg(F.count("*").alias("n"))


def rate_limited(events: DataFrame, by: list[str], at: str, tie: str, cap: int, zone: str = local.ZONE) -> DataFrame:
    """Add ``nth`` of the local day and whether it is under the cap."""
    nth = F.row_number().over(Window.partitionBy(*by, local.day_key(F.col(at), zone)).orderBy(at, tie))
    return events.withColumn("nth", nth).withColumn("under_cap", F.col("nth") <= cap)


# Statuses and what leads from one to the next.
STEPS = (
    ("new", "scored", "ready"), ("ready", "evidence_missing", "identity_pending"), ("identity_pending", "evidence_found", "ready"), ("ready", "select", "selected"),
    ("selected", "release", "ready"), ("selected", "publish", "published"), ("selected", "fail", "failed"), ("ready", "skip", "skipped"), ("failed", "repair", "ready"),
)


def run_machine(steps: DataFrame, by: list[str], event: str, order: list[str], start: str = "new", table: tuple[tuple[str, str, str], ...] = STEPS) -> DataFrame:
    """``(by, status, applied)``: each group's status after its events in order, those that lead nowhere left out.

    A group's events are gathered, so a group is one row's bounded history.
    """
    known = F.create_map(*(F.lit(x) for s, e, t in table for x in (f"{s}>{e}", t)))
    history = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_event")))), lambda s: s["_event"])

    def step(acc: Column, e: Column) -> Column:
        to = F.try_element_at(known, F.concat(acc["status"], F.lit(">"), e))
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["applied"] + to.isNotNull().cast("int")).alias("applied"))

    end = F.aggregate(history, F.struct(F.lit(start).alias("status"), F.lit(0).alias("applied")), step)
    return steps.groupBy(*by).agg(end.alias("_end")).select(*by, "_end.status", "_end.applied")


def cursor_after(head_failed: Column, head_cursor: Column, old_cursor: Column, resumed_cursor: Column) -> Column:
    """``(cursor, deferred)``: a failed head keeps the old cursor; one that overran is the new one; else where the backlog got to.

    Either of the first two defers the backlog.
    """
    cursor = F.when(head_failed, old_cursor).when(head_cursor.isNotNull(), head_cursor).otherwise(resumed_cursor)
    return F.struct(cursor.alias("cursor"), (head_failed | head_cursor.isNotNull()).alias("deferred"))


def crawl_from(last: Column, now: Column, overlap: int = 10, hours: int = 6) -> Column:
    """Where an overlapping re-read starts: shortly before the last crawl, or some hours ago."""
    return F.coalesce(last - F.expr(f"interval {overlap} minutes"), now - F.expr(f"interval {hours} hours"))


def yearly_memory(old: DataFrame, new: DataFrame, by: str, key: str, at: str, now: Column, most: int) -> DataFrame:
    """A seen-memory of the newest keys of each source, from this calendar year alone."""
    from . import gates

    fresh = lambda d: d.filter(F.year(at) == F.year(now))
    return gates.recency(fresh(old), fresh(new), by, key, at, most)


def reopened(status: Column, checks: Column, minutes: Column) -> Column:
    """An uncertain delivery is pending again after three checks, the last one twenty minutes on."""
    return F.when((status == "uncertain") & (checks >= 3) & (minutes >= 20), "pending").otherwise(status)


def stale_action(status: Column, deadline: Column, anchors: list[Column], now: Column) -> Column:
    """What maintenance does with a row by its first known time: old failures after seven days, undated open rows after sixty."""
    days = (times.micros(now) - times.micros(F.coalesce(*anchors))) / 86_400_000_000
    return ladders.first_of(
        (status.isin("new", "ready", "identity_pending") & (F.coalesce(F.trim(deadline), F.lit("")) == "") & (days > 60), "archive_undated"),
        (status.isin("skipped", "failed") & (days > 7), "archive_old"),
        otherwise="keep",
    )
