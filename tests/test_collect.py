"""Collectors, listing records, provider replies: corner cases beside the queries' oracles."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import cards
from sievewright.sources import api, collector, listings
from sievewright.streaming import jobs

RULES = collector.Rules(page_size=3, max_pages=4, max_items=7, streak=3, pages_a_batch=2)
#: Source to its pages' ids; "loop" leads back to its first page.
SITE = {"a": [["9", "8", "7"], ["6", "5", "4"], ["3", "2", "1"]], "loop": [["x1", "x2", "x3"], ["x4", "x5", "x6"]], "long": [[f"n{p}{i}" for i in range(3)] for p in range(9)]}


def site():
    """A function that workers get by value."""

    def fetch(source, cursor):
        pages = SITE[source]
        n = int(cursor)
        following = 0 if source == "loop" and n == len(pages) - 1 else n + 1
        return [(i, json.dumps({"id": i})) for i in pages[n]], str(following) if following < len(pages) else None

    return fetch


fetch = site()


def walked(source, kind, known, rules=RULES):
    walk = collector.Walk(source, kind, "0")
    while not walk.stop:
        rows, following = fetch(source, walk.cursor)
        walk = collector.advanced(walk, [i for i, _ in rows], following, frozenset(known), rules)
    return walk.stop, list(walk.visited), walk.items, walk.resume


def test_walks_end_for_a_reason():
    assert walked("a", "head", []) == ("end", ["0", "1", "2"], 9, "")
    assert walked("a", "head", ["7", "6", "5", "4"]) == ("seen_streak", ["0", "1"], 2, "")
    assert walked("a", "backlog", ["7", "6", "5", "4"]) == ("end", ["0", "1", "2"], 5, "")
    assert walked("loop", "head", []) == ("loop", ["0", "1"], 6, "")
    assert walked("long", "head", []) == ("max_items", ["0", "1", "2"], 9, "3")
    assert walked("long", "head", [], collector.Rules(page_size=3, max_pages=2)) == ("max_pages", ["0", "1"], 6, "2")
    assert collector.advanced(collector.Walk("a"), [], "1", frozenset(), RULES).stop == "end"


def rows_of(spark, path):
    return sorted((r.source, r.cursor, r.position, r.id) for r in spark.read.parquet(f"{path}/*").collect())


def test_a_stream_that_is_started_again_goes_on_and_replays_the_same(spark, tmp_path):
    spark.createDataFrame([("a", "8"), ("long", "n01"), ("loop", "other")], "source string, id string").write.parquet(f"{tmp_path}/known")
    walks = [(s, "head", "0") for s in SITE]

    def job(name, sink):
        stream = collector.collect(spark, fetch, walks, f"{tmp_path}/state-{name}", f"{tmp_path}/known", RULES)
        return stream, f"{tmp_path}/log-{name}", sink

    stream, log, sink = job("whole", jobs.append_to(f"{tmp_path}/whole"))
    collector.run(stream, sink, log)
    whole = rows_of(spark, f"{tmp_path}/whole")
    want = sorted((s, str(p), i, one) for s, pages in SITE.items() for p, page in enumerate(pages[:3]) for i, one in enumerate(page) if one not in ("8", "n01"))
    assert whole == want
    assert {(w.source, w.stop, w.resume) for w in collector.ended(f"{tmp_path}/state-whole")} == {("a", "end", ""), ("loop", "loop", ""), ("long", "max_items", "3")}
    assert collector.resumed(collector.ended(f"{tmp_path}/state-whole")) == [("long", "backlog", "3")]

    # the second batch fails in the sink; the query is started again from its checkpoint
    write = jobs.append_to(f"{tmp_path}/broken")

    def fails(batch, number):
        if number == 1:
            raise RuntimeError("lost")
        write(batch, number)

    with pytest.raises(Exception, match="lost"):
        collector.run(*(lambda s, c, k: (s, k, c))(*job("broken", fails)))
    assert rows_of(spark, f"{tmp_path}/broken") != whole
    stream, log, _ = job("broken", write)
    collector.run(stream, write, log)
    assert rows_of(spark, f"{tmp_path}/broken") == whole


def test_planned_pages_are_those_between_offsets(tmp_path):
    reader = collector.WalkReader(fetch, RULES, [collector.Walk("long", "head", "0")], "", str(tmp_path / "state"))
    first = reader.initialOffset()
    second = reader.latestOffset()
    assert [p.value[2] for p in reader.partitions(first, second)] == ["0", "1"]
    again = collector.WalkReader(fetch, RULES, [collector.Walk("long", "head", "0")], "", str(tmp_path / "state"))
    third = again.latestOffset()  # a new reader goes on where the last plan ended
    assert [p.value[2] for p in again.partitions(second, third)] == ["2"]
    assert again.partitions(third, third) == [] and again.latestOffset() == third
    (tmp_path / "state" / "999999999999.json").write_text("{torn")
    assert collector.WalkReader(fetch, RULES, [], "", str(tmp_path / "state")).latestOffset() == third


def page_of(spark, url, html):
    return spark.createDataFrame([(url, html)], "url string, html string")


def records(spark, adapter, url, html):
    return [r.asDict() for r in listings.records(page_of(spark, url, html), "url", "html", adapter, F.lit("2026-07-01").cast("date")).orderBy("position").collect()]


def test_dated_cards_of_headings_alone(spark):
    html = """<nav><a href="/01-02-2026/9/">Navigation link</a></nav><h2><a href="/05-07-2026/12/">Chargé de projet</a> <a href="/05-07-2026/13/">Second link here</a></h2>
    <h3><a href="/31-02-2026/14/">No such day at all</a></h3><h3><a href="https://www.tanmia.ma/06-07-2026/15">Coordinateur régional</a></h3><h2><a href="/05-07-2026/12/">Chargé de projet</a></h2>"""
    got = records(spark, "tanmia", "https://tanmia.ma/list", html)
    assert [(r["title"], r["published_at"], r["reference"]) for r in got] == [("Chargé de projet", "2026-07-05", ""), ("Coordinateur régional", "2026-07-06", "")]


def test_expired_cards_and_plain_links(spark):
    html = """<article class="offer-box"><a href="/offre/1">Formateur en électricité</a> Référence : AB 12 Date d'expiration : 30/06/2026</article>
    <article class="offer-box"><a href="/offre/2">Formateur en soudure</a> Référence : AB 13 Date d’expiration : 1-7-2026</article>
    <article class="offer-box"><a href="/offre/3">Formateur (Expirée)</a></article><a href="/offre/4">Gestionnaire des stocks</a><a href="/offres">Toutes les offres</a>"""
    got = records(spark, "ofppt", "https://recrutement.ofppt.ma/offres", html)
    assert [(r["title"], r["reference"], r["deadline"]) for r in got] == [("Formateur en soudure", "AB 13", "2026-07-01"), ("Gestionnaire des stocks", "", None)]


def test_a_date_is_not_borrowed_from_another_card(spark):
    html = """<div><div><a href="/jobs/12345678-a">First vacancy title</a></div><div><a href="/jobs/12345679-b">Second vacancy title</a><i>03/04/2026</i></div></div>"""
    got = records(spark, "alten", "https://www.alten.ma/jobs/", html)
    assert [(r["reference"], r["published_at"], r["company"]) for r in got] == [("12345678", None, "ALTEN MAROC"), ("12345679", "2026-04-03", "ALTEN MAROC")]


def test_titles_of_headings_where_links_have_none(spark):
    html = """<li><a href="/jobs/77-dev"><img></a><h3>Développeur</h3></li><li><a href="/jobs/78-x"></a></li><li><a href="https://other.example/jobs/79-y">Ailleurs</a></li>"""
    assert [(r["title"], r["reference"], r["provider"]) for r in records(spark, "inwi", "https://jobs.inwi.ma/jobs", html)] == [("Développeur", "77", "teamtailor")]


def test_article_links_prefer_articles_then_headings(spark):
    html = """<a href="/news/one">The first story</a><h2><a href="/news/two">The second story</a></h2><article><h2><a href="/news/one">The first story, told in an article</a></h2><p><a href="/news/three">A third story</a></article>
    <a href="https://elsewhere.example/n">Somewhere else</a><a href="/">Home of the site</a>"""
    got = [(r.url, r.title, r.score) for r in listings.article_links(page_of(spark, "https://s.example/", html), "url", "html").orderBy(F.desc("score"), "url").collect()]
    assert got == [("https://s.example/news/one", "The first story, told in an article", 13), ("https://s.example/news/three", "A third story", 6), ("https://s.example/news/two", "The second story", 3)]


@pytest.mark.parametrize("html", [None, "", "<", "<a href='x'", "<ul><li><a href='/jobs/77-a'>one<li><a href=/jobs/78-b>two</ul></div></div>", "<div>" * 3_000 + "<a href='/jobs/5-z'>deep</a>"])
def test_broken_pages(spark, html):
    links, around = cards.outline(html)
    assert all(0 <= i < len(around) for x in links for i in x["cards"])
    assert len(records(spark, "inwi", "https://jobs.inwi.ma/jobs", html)) == len([x for x in links if "/jobs/" in x["href"]])


def test_deep_state_of_a_page(spark):
    job = {"jobId": "1", "title": "Data  engineer", "country": "Morocco", "applyUrl": "https://apply.example/1", "jobSeqNo": "s1", "postedDate": "2026-01-02"}
    state = {"x": {"list": [{"more": [job]}, job | {"title": "again"}, job | {"jobSeqNo": "s2", "jobId": "2", "country": "France"}, job | {"jobSeqNo": "s3", "jobId": "3", "country": "", "location": "Rabat, Morocco", "applyUrl": ""}]}}
    html = f"<script>var a = {{}}; phApp.ddo = {json.dumps(state)}; phApp.x = {{}}</script>"
    pages = spark.createDataFrame([(1, html), (2, "<script>phApp.ddo = {broken</script>"), (3, None)], "id int, html string")
    got = [(r.id, r.title, r.reference, r.published_at) for r in api.phenom(pages, "id", "html").collect()]
    assert got == [(1, "Data engineer", "1", "2026-01-02")] or got == [(1, "again", "1", "2026-01-02")]


def test_depth_is_never_cut_off_unseen(spark):
    df = spark.createDataFrame([(1, '{"a":' * 4 + "1" + "}" * 4), (2, "7"), (3, None), (4, '[[{"b":{}}]]')], "id int, j string")
    assert sorted((r.id, r.path) for r in api.nodes(df, "j", 4).select("id", "path").collect()) == [(1, ""), (1, "a"), (1, "a.a"), (1, "a.a.a"), (4, "[0][0]"), (4, "[0][0].b")]
    with pytest.raises(Exception, match="more than 2 levels"):
        api.nodes(df, "j", 2).select("id", "path").collect()
