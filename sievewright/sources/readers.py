"""Readers of the state and listing formats, as DataFrames.

All declare their schemas: nothing is inferred, junk becomes null or a corrupt-record row.
Transport (HTTP, OAuth, OCR) stays outside; readers take files or a page-fetching callable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import texts, times, urls
from ..operators import html, tables

SOURCE = "name string, base_url string, feed_url string, enabled boolean, extractor_type string, category_hint string, fetch_limit_per_run int"
REGISTRY = f"categories array<struct<key: string, name: string, label: string, sources: array<struct<{SOURCE.replace(' ', ': ').replace(',: ', ', ')}>>>>, sources array<struct<{SOURCE.replace(' ', ': ').replace(',: ', ', ')}>>"
CAMPAIGN = "campaign_id string, identity_key string, semantic_key string, status string, url string, title string, company string, updated_at string"
RUN = "run_id string, finished_at string, success boolean, sources_checked int, candidates_found int, published_url string"
FEED_ITEM = "title string, link array<struct<_VALUE: string, _href: string, _rel: string>>, guid string, id string, pubDate string, published string, updated string, date string, description string, summary string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of the job categories, each with its category; a flat list where there are none."""
    raw = spark.read.schema(REGISTRY).json(path, multiLine=True)
    nested = raw.select(F.explode("categories").alias("c")).filter("c.key like 'jobs-%' or c.label like 'jobs-%' or c.key = 'remote-jobs' or c.label = 'remote-jobs'")
    inner = nested.select(F.col("c.key").alias("category_key"), F.coalesce("c.label", "c.name", "c.key").alias("category_label"), F.explode("c.sources").alias("s"))
    flat = raw.filter("categories is null").select(F.lit(None).cast("string").alias("category_key"), F.lit(None).cast("string").alias("category_label"), F.explode("sources").alias("s"))
    return inner.union(flat).select("category_key", "category_label", "s.*").withColumn("category_hint", F.coalesce("category_hint", "category_label"))


def lint(sources: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``(name, reason)`` for every violated rule, duplicate addresses included."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("enabled").isNull(), F.lit("enabled is neither true nor false")),
            F.when(~F.coalesce(F.col("category_hint").isin(*categories), F.lit(False)), F.lit("unknown category")),
            F.when(~F.coalesce(F.col("fetch_limit_per_run") >= 1, F.lit(False)), F.lit("limit is no positive integer")),
            F.when(F.coalesce(F.trim("base_url"), F.lit("")) == "", F.lit("no address")),
        )
    )
    broken = sources.select("name", F.explode(rules).alias("reason"))
    own = sources.select("name", F.lower(F.regexp_replace(F.trim("base_url"), "/+$", "")).alias("u")).filter("u <> ''")
    twice = own.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    return broken.union(own.join(twice, "u", "left_semi").select("name", F.lit("duplicate address").alias("reason")))


def queue(spark: SparkSession, path: str, article: str) -> DataFrame:
    """Articles of a queue document; a corrupt document has none."""
    raw = spark.read.schema(f"updated_at string, articles array<struct<{article}>>").json(path, multiLine=True, mode="PERMISSIVE")
    return raw.select(F.posexplode("articles").alias("position", "a")).select("position", "a.*")


def storage_status(spark: SparkSession, path: str) -> DataFrame:
    """``ok``, ``invalid_shape`` or ``corrupt`` of each document."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json(F.ltrim(F.col("value"), F.lit("﻿"))).alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.articles", "variant"))
    return raw.select("file", F.when(F.col("v").isNull(), "corrupt").when(~F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)), "invalid_shape").otherwise("ok").alias("status"))


def campaigns(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Active campaigns with an address, newest first, of a folder of files of one record, or of an array of records, each."""
    raw = spark.read.schema(CAMPAIGN).option("recursiveFileLookup", True).option("multiLine", True).json(path)
    active = raw.filter("coalesce(nullif(status, ''), 'active') = 'active' and coalesce(url, '') <> ''").orderBy(F.desc("updated_at"), "campaign_id")
    return active.limit(max(1, limit)) if limit is not None else active


def run_log(spark: SparkSession, path: str, tail: int = 672) -> DataFrame:
    """The newest runs of a line-by-line log; junk lines are left out."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("finished_at"), F.desc("run_id")).limit(tail)


def feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS (``item``) or Atom (``entry``) files: title, address, time, summary; the first of an address."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(FEED_ITEM).load(path)
    at = F.coalesce("published", "pubDate", "updated", "date")
    # a link is text, or an attribute whose relation is none or "alternate"
    links = F.transform(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), lambda x: F.coalesce(F.nullif(F.trim(x["_VALUE"]), F.lit("")), F.trim(x["_href"])))
    link = F.try_element_at(F.filter(links, lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(1))
    shaped = raw.select(
        texts.clean(F.col("title")).alias("title"),
        F.trim(F.coalesce(link, "guid", "id")).alias("url"),
        F.coalesce(times.parse(at), F.try_to_timestamp(F.regexp_replace(at, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))).alias("published_at"),
        texts.clean(F.coalesce("description", "summary")).alias("summary"),
    ).filter("title <> '' and url <> ''")
    return tables.keep_first(shaped, ["url"], "published_at", "title")


# Listing adapters: host, path of a detail page (the whole path), least title length.
ADAPTERS: dict[str, dict[str, Any]] = {
    "tanmia": {"host": "tanmia.ma", "path": r"/\d{2}-\d{2}-20\d{2}/\d+(?:/.*)?", "title": 8},
    "accor": {"host": "careers.accor.com", "path": r"/global/en/job/.*-jid-\d+", "title": 8},
    "alten": {"host": "alten.ma", "path": r"/jobs/\d{8,}-.*", "title": 8},
    "inwi": {"host": None, "path": r"/jobs/\d+-.*", "title": 1},
    "credit_du_maroc": {"host": None, "path": r"/offre-de-emploi/emploi-.*_\d+\.aspx", "title": 1},
    "cih": {"host": None, "path": r"/\d+_offre-emploi-.*\.html", "title": 1},
    "capgemini": {"host": "careers.capgemini.com", "path": r"/job/.*\d+", "title": 4},
    "etalent": {"host": None, "path": r"/offre/\d+(?:/.*)?", "title": 4},
    "ofppt": {"host": None, "path": r"/offre/\d+(?:/.*)?", "title": 8},
}


def resolve(base: Column, href: Column) -> Column:
    """An anchor's address against its page's."""
    root = F.concat(urls.part(base, 1), F.lit("://"), urls.part(base, 2))
    bare = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(urls.part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(href == "", bare)
        .when(F.startswith(href, F.lit("#")), F.concat(bare, href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(bare, "[?].*$", ""), href))
        .otherwise(F.concat(root, F.regexp_replace(urls.path(base), "[^/]*$", ""), href))
    )


def listing(pages: DataFrame, id_col: str, html_col: str, url_col: str, adapter: str | None = None) -> DataFrame:
    """``(url_col, title, url, reference)`` of the links that an adapter, or the general filter, keeps; the first of an address."""
    links = html.parsed(pages, id_col, html_col).join(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("page_url")), F.col(id_col) == F.col("_id"))
    found = links.select("page_url", F.posexplode("links").alias("position", "l")).select("page_url", "position", texts.clean(F.col("l.label")).alias("title"), resolve(F.col("page_url"), F.col("l.href")).alias("url"))
    if adapter:
        rule = ADAPTERS[adapter]
        own = F.lit(True) if rule["host"] is None else urls.host(F.col("url")) == rule["host"]
        kept = found.filter(own & urls.path(F.col("url")).rlike(f"^(?:{rule['path']})/?$") & (F.char_length("title") >= rule["title"]))
    else:
        kept = found.filter(urls.is_likely_article(F.col("title"), F.col("url"), F.col("page_url")))
    keyed = kept.withColumn("key", urls.canonical_job(F.col("url")))
    first = tables.keep_first(keyed, ["page_url", "key"], "position")
    return first.select("page_url", "position", "title", F.col("key").alias("url"), urls.reference(F.col("url")).alias("reference"))


def api_rows(replies: DataFrame, column: str, row: str, path: str) -> DataFrame:
    """Rows of JSON replies: the array at ``path`` (one key), each with the declared fields."""
    parsed = replies.withColumn("_r", F.from_json(column, f"`{path}` array<struct<{row}>>"))
    return parsed.select(*replies.columns, F.posexplode(F.col(f"_r.{path}")).alias("position", "r")).drop(column).select("*", "r.*").drop("r")


class Pages(DataSource):
    """A paged listing as a batch source: ``fetch(cursor)`` gives rows and the next cursor.

    Subclasses set ``fetch``.  A repeated cursor, the page cap or an empty page ends the walk.
    """

    fetch: Callable[[str], tuple[list[tuple], str | None]]
    max_pages = 12

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "cursor string, id string, title string, url string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(type(self).fetch, self.options.get("starts", "").split(","), type(self).max_pages)


class PagesReader(DataSourceReader):
    def __init__(self, fetch: Callable, starts: list[str], max_pages: int) -> None:
        self.fetch, self.starts, self.max_pages = fetch, starts, max_pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(start) for start in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor, seen = partition.value, set()
        while cursor is not None and cursor not in seen and len(seen) < self.max_pages:
            seen.add(cursor)
            rows, following = self.fetch(cursor)
            for row in rows:
                yield (cursor, *row)
            cursor = following if rows else None


def is_complete(rows: DataFrame, key: str) -> DataFrame:
    """Whether an export has each id once."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids")).withColumn("complete", F.col("rows") == F.col("ids"))


def within_budget(df: DataFrame, by: list[str], size: Column, budget: int, *order: Column | str) -> DataFrame:
    """Rows in order while their sizes fit a budget together."""
    running = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_sum", running).filter(F.col("_sum") <= budget).drop("_sum")


STATE = "sources map<string, struct<last_crawled_at: string, discovery_last_status: string, discovery_last_new_count: int>>"


def crawl_state(spark: SparkSession, path: str) -> DataFrame:
    """``(source, last_crawled_at, status, new_count)`` of a keyed state document; one of another shape has none."""
    raw = spark.read.schema(STATE).option("mode", "PERMISSIVE").json(path, multiLine=True)
    found = raw.select(F.explode("sources").alias("source", "s")).filter("s is not null")
    return found.select("source", times.parse(F.col("s.last_crawled_at")).alias("last_crawled_at"), F.col("s.discovery_last_status").alias("status"), F.coalesce("s.discovery_last_new_count", F.lit(0)).alias("new_count"))


def by_identity(keys: DataFrame, pointers: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Two hops: ``keys (identity_key)`` to ``pointers (identity_key, campaign_id)`` to the campaign; those that lead nowhere are left out."""
    return keys.join(pointers, "identity_key").join(campaigns.drop("identity_key"), "campaign_id")


def by_semantic(keys: DataFrame, index: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``keys (semantic_key)`` to all campaigns that ``index (semantic_key, campaign_ids)`` lists and that are still there."""
    return keys.join(index.select("semantic_key", F.explode("campaign_ids").alias("campaign_id")), "semantic_key").join(campaigns.drop("semantic_key"), "campaign_id")


#: What reads a source, by its declared type; the general filter reads the others.
EXTRACTORS = {**{name: "listing" for name in ADAPTERS}, "workday": "api", "csod": "api", "phenom": "embedded", "smartrecruiters": "api", "rss": "feed", "atom": "feed"}


def dispatched(sources: DataFrame) -> DataFrame:
    """Add ``reader``: what reads each source, a declared feed before its type."""
    table = F.create_map(*(F.lit(x) for kv in EXTRACTORS.items() for x in kv))
    kind = F.lower(F.trim(F.coalesce("extractor_type", F.lit(""))))
    return sources.withColumn("reader", F.when(F.trim(F.coalesce("feed_url", F.lit(""))) != "", F.lit("feed")).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("general"))))


def stamped(rows: DataFrame, sources: DataFrame, source: str, now: Column) -> DataFrame:
    """Rows with their source's columns and the time of discovery; rows of unknown or disabled sources are left out."""
    own = sources.filter("coalesce(enabled, true)").select(F.col("name").alias("_name"), "category_hint", "extractor_type")
    return rows.join(own, F.col(source) == F.col("_name")).drop("_name").withColumn("discovered_at", now)
