"""Readers and sinks over literal files."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import facts, tables
from sievewright.sources import readers, sinks


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_registry_and_lint(spark, tmp_path):
    source = lambda n, u, **x: {"name": n, "base_url": u, "enabled": True, "category_hint": "jobs-it", "fetch_limit_per_run": 3} | x
    doc = {
        "categories": [
            {"key": "jobs-it", "name": "IT", "sources": [source("a", "https://x/"), source("b", "HTTPS://x"), source("c", "", fetch_limit_per_run=0, enabled=None)]},
            {"key": "news", "sources": [source("d", "https://y")]},
        ]
    }
    rows = readers.registry(spark, put(tmp_path, "s.json", json.dumps(doc)))
    assert sorted(r.name for r in rows.collect()) == ["a", "b", "c"]
    found = {(r.name, r.reason) for r in readers.lint(rows, ("jobs-it",)).collect()}
    assert found == {("a", "duplicate address"), ("b", "duplicate address"), ("c", "enabled is neither true nor false"), ("c", "limit is no positive integer"), ("c", "no address")}
    flat = readers.registry(spark, put(tmp_path, "f.json", json.dumps({"sources": [source("z", "https://z")]})))
    assert [r.name for r in flat.collect()] == ["z"]


def test_queue_and_storage_status(spark, tmp_path):
    put(tmp_path, "q/good.json", json.dumps({"articles": [{"id": "1", "url": "u"}, {"id": "2"}]}))
    put(tmp_path, "q/bad.json", '{"articles": [')
    put(tmp_path, "q/shape.json", '{"articles": {}}')
    rows = readers.queue(spark, str(tmp_path / "q" / "good.json"), "id: string, url: string")
    assert [(r.position, r.id, r.url) for r in rows.collect()] == [(0, "1", "u"), (1, "2", None)]
    assert readers.queue(spark, str(tmp_path / "q" / "bad.json"), "id: string").count() == 0
    states = {r.file.rsplit("/", 1)[1]: r.status for r in readers.storage_status(spark, str(tmp_path / "q")).collect()}
    assert states == {"good.json": "ok", "bad.json": "corrupt", "shape.json": "invalid_shape"}


def test_campaigns_and_run_log(spark, tmp_path):
    for i, (status, url) in enumerate([("active", "u"), ("", "u"), ("closed", "u"), ("active", "")]):
        put(tmp_path, f"c/{i:02d}/{i}.json", json.dumps({"campaign_id": str(i), "status": status, "url": url, "updated_at": f"2024-01-0{i + 1}"}))
    assert [r.campaign_id for r in readers.campaigns(spark, str(tmp_path / "c")).collect()] == ["1", "0"]
    log = put(tmp_path, "log.jsonl", "\n".join([json.dumps({"run_id": str(i), "finished_at": f"2024-01-0{i}", "success": True}) for i in (1, 2, 3)] + ["{junk"]))
    assert [r.run_id for r in readers.run_log(spark, log, 2).collect()] == ["3", "2"]


def test_feed(spark, tmp_path):
    item = "<item><title> A  b </title><link>https://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate><description>d</description></item>"
    path = put(tmp_path, "feed.xml", f"<rss><channel>{item}{item}<item><title></title><link>https://x/2</link></item></channel></rss>")
    rows = readers.feed(spark, path).collect()
    assert [(r.title, r.url, str(r.published_at), r.summary) for r in rows] == [("A b", "https://x/1", "2024-01-02 09:00:00", "d")]


def test_listing_adapter(spark):
    html = '<a href="/jobs/12345678-data-engineer">Data engineer</a><a href="/jobs/12345678-data-engineer/">Again, here</a><a href="/about">About the firm</a><a href="//alten.ma/jobs/87654321-x">Short</a>'
    pages = spark.createDataFrame([(1, html, "https://www.alten.ma/jobs")], "id bigint, html string, url string")
    got = readers.listing(pages, "id", "html", "url", "alten").collect()
    assert [(r.title, r.url) for r in got] == [("Data engineer", "https://alten.ma/jobs/12345678-data-engineer")]


def test_paged_source_stops_on_a_repeated_cursor(spark):
    class Loop(readers.Pages):
        @classmethod
        def name(cls):
            return "loop"

        @staticmethod
        def fetch(cursor):
            return [(f"{cursor}-1", "t", "u")], {"a": "b", "b": "a"}.get(cursor)

    spark.dataSource.register(Loop)
    rows = spark.read.format("loop").option("starts", "a,z").load()
    assert sorted(r.id for r in rows.collect()) == ["a-1", "b-1", "z-1"]
    assert readers.is_complete(rows, "id").collect()[0].complete


def test_api_rows(spark):
    df = spark.createDataFrame([(1, '{"content": [{"id": "7", "name": "n"}, {"id": "8"}]}'), (2, "junk")], "page int, body string")
    assert [(r.page, r.id, r.name) for r in readers.api_rows(df, "body", "id: string, name: string", "content").collect()] == [(1, "7", "n"), (1, "8", None)]


def test_write_only_when_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    path = str(tmp_path / "t")
    known = sinks.write_if_changed(df, path, None)
    assert sinks.write_if_changed(df.orderBy(F.desc("i")), str(tmp_path / "never"), known) == known
    assert not (tmp_path / "never").exists() and spark.read.parquet(path).count() == 2
    assert sinks.content_hash(df.union(df)) != known
    # a table that is made of the one it replaces; no other version is left
    sinks.write_if_changed(spark.read.parquet(path).filter("i = 1"), path, known)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "a")] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="boom"):
        sinks.write_version(spark.range(3).select(F.raise_error(F.lit("boom")).alias("i")), path)
    assert spark.read.parquet(path).count() == 1


def test_archive_keeps_other_months_and_the_months_own_rows(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, at string").withColumn("at", F.to_timestamp("at"))
    sinks.archive_by_month(rows((1, "2024-01-01"), (1, "2024-01-05"), (2, "2024-02-01")), ["id"], "at", path)
    sinks.archive_by_month(rows((3, "2024-02-02")), ["id"], "at", path)
    got = sorted((str(r.month)[:7], r.id, r["at"].day) for r in spark.read.option("inferSchema", False).parquet(path).withColumn("month", F.col("month").cast("string")).collect())
    assert got == [("2024-01", 1, 5), ("2024-02", 2, 1), ("2024-02", 3, 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["a"]  # nothing is left beside it


def test_link_cache(spark):
    old = spark.createDataFrame([("a", "2024-01-01"), ("b", "2023-01-01"), ("c", "2024-01-02")], "url string, at string").withColumn("at", F.to_date("at"))
    new = spark.createDataFrame([("a", "2024-01-09")], "url string, at string").withColumn("at", F.to_date("at"))
    assert [r.url for r in sinks.link_cache(old, new, "url", "at", "2024-01-10").collect()] == ["a", "c"]


def test_table_facts(spark):
    tables = [[["Post", "City", "Seats"], ["Dev", "Rabat", "12"], ["Ops", "Fes", "3"]], [["Deadline", "2024-05-01"]]]
    df = spark.createDataFrame([(1, tables)], "id int, t array<array<array<string>>>")
    got = {(r.category, r.value) for r in facts.from_tables(df, "id", "t", {"positions": "Seats", "deadline": "Deadline"}).collect()}
    assert got == {("positions", "12"), ("positions", "3"), ("deadline", "2024-05-01")}


def test_feeds(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://x.example/1" rel="alternate"/><id>tag:1</id><updated>2024-01-02T03:04:05Z</updated></entry><entry><title>U</title><id>https://x.example/2</id></entry></feed>')
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>A</title><link>https://x.example/3</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title></title><link>https://x.example/4</link></item></channel></rss>")
    atom = {r.title: r for r in readers.feed(spark, str(tmp_path / "atom.xml"), "entry").collect()}
    assert (atom["T"].url, atom["U"].url) == ("https://x.example/1", "https://x.example/2") and atom["T"].published_at is not None
    assert [(r.title, r.url) for r in readers.feed(spark, str(tmp_path / "rss.xml")).collect()] == [("A", "https://x.example/3")]


def test_related_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1, 2, 3]), rng.choice("xyz"), rng.choice("pq")) for i in range(120)]
    weights = {"t": 8, "s": 4, "n": 2}
    got = sorted((r.i, r.related, r.points) for r in tables.related(spark.createDataFrame(rows, "i int, g string, t int, s string, n string"), "i", "g", weights, 3).collect())
    want = []
    for i, g, *own in rows:
        scored = sorted((-sum(w for w, x, y in zip(weights.values(), own, other, strict=True) if x is not None and x == y), j) for j, h, *other in rows if h == g and j != i)
        want += [(i, j, -p) for p, j in scored[:3] if p]
    assert got == sorted(want)


def test_similar_titles_with_a_number_in_common(spark):
    rows = [(1, ["cve-2024-1", "flaw", "parser"]), (2, ["flaw", "other", "words", "here"]), (3, ["parser", "news", "of", "day"]), (4, ["a", "b", "c"]), (5, ["a", "b", "c", "d"]), (6, ["c", "b", "a"])]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    pairs = tables.overlap_pairs(df, "k", "t", 0.62, marked="^cve-")
    assert sorted((r.left, r.right) for r in pairs.collect()) == [(1, 2), (1, 3), (4, 5)]
    got = {r.k: (r.rep, r.links) for r in tables.linked_classes(df, "k", "t", pairs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 6: (4, 1), 5: (5, 1)}
    reasons = tables.duplicate_reasons(df.withColumn("h", F.size("t")), "k", [("size", "h")], pairs.select(F.col("right").alias("k"), F.col("left").alias("earlier")))
    assert {r.k: (r.reason, r.earlier) for r in reasons.collect()} == {3: ("size", 2), 4: ("size", 1), 5: ("size", 2), 6: ("size", 1), 2: ("similar", 1)}
