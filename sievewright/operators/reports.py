"""Reports over queues, runs and documents: roll-ups, blockers, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, ladders, texts, times
from . import tables


def blocker(queue: DataFrame, now: Column) -> DataFrame:
    """One row: why nothing was selected from ``queue (status, skip_reason, retry_at, fetched, hold, quality_reason)``.

    ``(reason, n, top, earliest_retry)``; the reasons are tried in order.
    """
    ready = F.col("status").isin("ready", "selected")
    waiting = ready & F.coalesce(F.col("retry_at") > now, F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    one = queue.agg(
        F.count("*").alias("active"), count(ready).alias("ready"), count(F.col("status") == "skipped").alias("skipped"), count(waiting).alias("waiting"),
        F.min(F.when(waiting, F.col("retry_at"))).alias("earliest"), count(ready & F.col("hold")).alias("holds"), count(ready & ~F.col("fetched")).alias("unfetched"),
    )
    top = lambda rows, c, name: rows.filter(F.coalesce(F.trim(c), F.lit("")) != "").groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias(name))
    skipped, quality = top(queue.filter("status = 'skipped'"), "skip_reason", "top_skip"), top(queue.filter(ready), "quality_reason", "top_quality")
    met = one.join(F.broadcast(skipped)).join(F.broadcast(quality))  # one row each
    reason = ladders.first_of(
        (F.col("active") == 0, "empty"), (F.col("ready") == 0, "none_ready"), (F.col("waiting") == F.col("ready"), "cooling_down"), (F.col("top_quality").isNotNull(), "quality"),
        (F.col("holds") > 0, "identity"), (F.col("unfetched") > 0, "content"), otherwise="unselected",
    )
    n = F.when(reason == "none_ready", F.col("skipped")).when(reason == "identity", F.col("holds")).when(reason == "content", F.col("unfetched")).otherwise(F.col("ready"))
    named = F.when(reason == "none_ready", F.col("top_skip")).when(reason == "quality", F.col("top_quality"))
    return met.select(reason.alias("reason"), n.alias("n"), named.alias("top"), F.when(reason == "cooling_down", F.col("earliest")).alias("earliest_retry"))


def schedule(published: DataFrame, at: str, kind: str, now: Column, minutes: int) -> DataFrame:
    """``(drafts, lives, last, next_allowed, allowed)`` of the day of ``now``."""
    today = F.to_date(at) == F.to_date(now)
    last = F.max(F.col(at).cast("timestamp"))
    return published.agg(
        F.count_if(today & (F.col(kind) == "draft")).alias("drafts"), F.count_if(today & (F.col(kind) == "live")).alias("lives"), last.alias("last"), (last + F.expr(f"interval {minutes} minutes")).alias("next_allowed")
    ).withColumn("allowed", F.coalesce(F.col("next_allowed") <= now, F.lit(True)))


def confidence_summary(facts: DataFrame, id_col: str) -> DataFrame:
    """Facts of each row by confidence, and the row's own: the best it has."""
    n = lambda level: F.count_if(F.col("confidence") == level).alias(level)
    return facts.groupBy(id_col).agg(n("high"), n("medium"), n("low")).withColumn("confidence", ladders.first_of((F.col("high") > 0, "high"), (F.col("medium") > 0, "medium"), otherwise="low"))


def oldest(df: DataFrame, by: list[str], at: str, now: Column) -> DataFrame:
    """The age in minutes of each group's oldest row; 0 where none has a time."""
    age = F.floor((times.micros(now) - times.micros(F.min(at))) / 60_000_000)
    return df.groupBy(*by).agg(F.coalesce(age, F.lit(0)).cast("long").alias("oldest_minutes"))


def roll_up(runs: DataFrame, at: str, ok: str, found: str, now: Column, hours: int = 24) -> DataFrame:
    """``(runs, succeeded, failed, found, last_ok)`` of the last hours."""
    recent = runs.filter((times.micros(F.col(at)) > times.micros(now) - hours * 3_600_000_000) & (times.micros(F.col(at)) <= times.micros(now)))
    return recent.agg(F.count("*").alias("runs"), F.count_if(ok).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"), F.coalesce(F.sum(found), F.lit(0)).cast("long").alias("found"), F.max(F.when(F.col(ok), F.col(at))).alias("last_ok"))


# Weights of an audit's issues.
ISSUES = {
    "arabic_title": 30, "arabic_body": 30, "duplicate_headings": 15, "invalid_link": 15, "tiny_heading": 10, "image_without_alt": 5, "short_text": 5, "long_without_h2": 5, "inline_h1": 5, "long_without_internal_link": 3,
}


def audit(df: DataFrame, html: str, title: str, text: Column, own_host: str) -> DataFrame:
    """Add ``words, issues, weight``: what is wrong with a published page's markup, and how much it matters."""
    source, words = F.coalesce(F.col(html), F.lit("")), texts.word_count(text)
    headings = F.transform(F.regexp_extract_all(source, F.lit(r"(?is)<h[23]\b[^>]*>(.*?)</h[23]>"), F.lit(1)), lambda h: F.lower(texts.clean(F.regexp_replace(h, "<[^>]+>", " "))))
    named = F.filter(headings, lambda h: h != "")
    hrefs = F.regexp_extract_all(source, F.lit(r"""(?i)<a\b[^>]*\bhref=["']([^"']*)["']"""), F.lit(1))
    images = F.regexp_extract_all(source, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    arabic = r"[\x{0600}-\x{06FF}]"
    found = ladders.reasons(
        (F.coalesce(F.col(title), F.lit("")).rlike(arabic), "arabic_title"),
        (F.regexp_count(text, F.lit(arabic)) >= 20, "arabic_body"),
        (F.size(named) > F.size(F.array_distinct(named)), "duplicate_headings"),
        (F.exists(hrefs, lambda h: (F.trim(h) == "") | F.startswith(F.lower(F.trim(h)), F.lit("javascript:"))), "invalid_link"),
        (F.exists(headings, lambda h: F.char_length(h) <= 3), "tiny_heading"),
        (F.exists(images, lambda i: ~i.rlike(r"""(?i)\balt=["']\s*[^"'\s]""")), "image_without_alt"),
        (words < 250, "short_text"),
        ((words >= 400) & ~source.rlike(r"(?i)<h2\b"), "long_without_h2"),
        (source.rlike(r"(?i)<h1\b"), "inline_h1"),
        ((words >= 500) & ~F.exists(hrefs, lambda h: F.contains(F.lower(h), F.lit(own_host))), "long_without_internal_link"),
    )
    weight = F.create_map(*(F.lit(x) for kv in ISSUES.items() for x in kv))
    return df.withColumn("words", words).withColumn("issues", found).withColumn("weight", F.aggregate("issues", F.lit(0), lambda n, i: n + F.coalesce(weight[i], F.lit(0))))


def evidence(reference: Column, deadline: Column, positions: Column, table_facts: Column, document_facts: Column, document_urls: Column) -> Column:
    """``(signature, strength, comparison_strength, categories)``: the reference and the addresses count, but are not compared."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    kinds = ((full(reference), "reference", 4, 0), (full(deadline), "deadline", 1, 1), (F.coalesce(positions, F.lit(0)) > 0, "positions", 1, 1), (some(table_facts), "tables", 2, 2), (some(document_facts), "pdf_text", 3, 3), (some(document_urls), "documents", 1, 0))
    total = lambda i: sum((F.when(k[0], k[i]).otherwise(0) for k in kinds), F.lit(0))
    compared = {"deadline": deadline, "document_facts": F.array_sort(document_facts), "positions": positions, "table_facts": F.array_sort(table_facts)}
    signature = F.when(total(3) > 0, jsons.signature(compared, 24)).otherwise("")
    return F.struct(signature.alias("signature"), total(2).alias("strength"), total(3).alias("comparison_strength"), ladders.reasons(*((c, label) for c, label, *_ in kinds)).alias("categories"))


def usage(df: DataFrame, keys: list[str], most: int, *newest: Column | str) -> DataFrame:
    """How often each value of ``keys`` is used among the newest rows."""
    recent = df.orderBy(*newest).limit(most)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("style"), F.col(k).cast("string").alias("value")) for k in keys)))
    return recent.select(pairs.alias("u")).groupBy("u.style", "u.value").agg(F.count("*").alias("n"))


def last_days(df: DataFrame, day: str, most: int) -> DataFrame:
    """Rows of the newest ``most`` different days."""
    kept = df.select(day).distinct().orderBy(F.desc(day)).limit(most)
    return df.join(F.broadcast(kept), day, "left_semi")


def engagement(df: DataFrame, by: list[Column], value: str, places: int, day: Column) -> DataFrame:
    """``(by, samples, days, mean)``: rows, different days and the mean value, rounded half up."""
    cents = F.sum(F.round(F.col(value) * 100).cast("long"))
    return df.groupBy(*by).agg(F.count("*").alias("samples"), F.countDistinct(day).alias("days"), tables.mean_tenths(cents, F.count("*"), places).alias("mean"))


def with_flag(cells: DataFrame, enough: str, least: int, name: str) -> DataFrame:
    """Add ``name``: whether at least so many cells have enough."""
    return cells.join(F.broadcast(cells.agg((F.count_if(enough) >= least).alias(name))))  # one row
