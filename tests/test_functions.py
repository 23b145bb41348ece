"""Literal fixtures with a fixed ``now``."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievewright.functions import ladders, numbers, texts, times, urls
from sievewright.operators import html, tables
from sievewright.streaming import jobs
from sievewright.streaming.jobs import health_step


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return row.select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Ex.com//a//b/?utm_source=x&b=2&a=#top", "https://ex.com/a/b?b=2&a="),
        ("https://ex.com", "https://ex.com/"),
        ("  not a url ", "not a url"),
        (None, ""),
        ("https://ex.com/a?ref=1&spm=2&flag", "https://ex.com/a?flag="),
    ],
)
def test_canonical(spark, url, expected):
    assert value(spark, urls.canonical(F.col("u").cast("string")), u=url) == expected


def test_job_url_is_https_sorted_and_bare(spark):
    assert value(spark, urls.canonical_job(F.lit("http://www.Ex.com/jobs/?z=1&trk=2&a=3"))) == "https://ex.com/jobs?a=3&z=1"


@pytest.mark.parametrize(("url", "ref"), [("https://x.ma/job?jobId=AB-7", "ab-7"), ("https://x.ma/jobs/12345/dev", "12345"), ("https://x.ma/about", ""), (None, "")])
def test_reference(spark, url, ref):
    assert value(spark, urls.reference(F.col("u").cast("string")), u=url) == ref


@pytest.mark.parametrize("path", ["/%d8%a7", "/ا", "/a%2Fb c", "/a+b", "/100%", "/a~b!*'()@:$&,;=", "/%zz%41", "/plain-path_1.html", "/é%C3%A9"])
def test_paths_are_spelled_as_the_library_does(spark, path):
    from urllib.parse import quote, unquote

    safe = "/:@!$&'()*+,;=-._~"
    assert value(spark, urls.spelled(F.col("u"), safe, "/"), u=path) == quote(unquote(path), safe=safe)


def test_topics(spark):
    assert value(spark, texts.topic_keywords(F.lit("The new CVE-2024-1234 in the Parser, the parser"))) == ["cve-2024-1234", "parser"]
    assert value(spark, texts.topic_keywords(F.lit(None).cast("string"))) == []
    same = [value(spark, texts.topic_signature(F.lit(t))) for t in ("Alpha beta gamma", "gamma, beta: alpha")]
    assert same[0] == same[1]


def test_redact(spark):
    assert value(spark, texts.redact(F.lit("a  Bearer abc.def api_key: 'k1' access_token=zz&x"))) == "a Bearer [redacted] api_key: '[redacted]' access_token=[redacted]"


def test_dates(spark):
    assert value(spark, texts.dates(F.lit("3/2/2024, 2024-02-03, 31/02/2024, 12345/1/2024"))) == ["2024-02-03"]


def test_freshness_bounds(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    of = lambda at, day: value(spark, times.freshness(F.lit(at).cast("timestamp"), F.lit(day), F.lit("job"), now))
    assert of("2024-01-01 00:00:00", False).fresh and not of("2023-12-31 23:59:59", False).fresh
    assert not of("2024-01-01", True).fresh and of("2024-01-02", True).fresh
    assert of("2024-01-03", False).future and not of(None, False).known


def test_backoff(spark):
    assert [value(spark, times.backoff(15, F.lit(n), 7, 1440)) for n in (1, 2, 8, 50)] == [15, 30, 1440, 1440]


def test_ladders(spark):
    assert value(spark, ladders.score({"official": F.lit(True), "fresh": F.lit(None).cast("boolean"), "salary": F.lit(True)})) == 30
    health = lambda *n: tuple(value(spark, ladders.day_health(*map(F.lit, n))))
    assert health(1, 5, 0, 0, 0, 9) == ("red", -4) and health(0, 0, 0, 0, 0, 1) == ("green", 1) and health(0, 0, 0, 0, 0, 0) == ("neutral", 0)
    assert [value(spark, ladders.step(F.lit(v), (0, 2, 4), (8, 9, 10))) for v in (0, 3, 9)] == [8, 9, 10]
    assert value(spark, ladders.urgency(F.lit("vacancy"), F.lit(True), F.lit(None).cast("int"), F.lit(150))) == "high"


def test_upsert_keeps_good_values(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, " "), (3, "c")], "k int, v string")
    got = {r.k: (r.v, r.merge_state) for r in tables.upsert_non_blank(old, new, "k", ["v"]).collect()}
    assert got == {1: ("a", "keep"), 2: ("b", "update"), 3: ("c", "insert")}


def test_streak_cut_and_tail(spark):
    rows = [("s", i, k) for i, k in enumerate([True, False, True, True, False])]
    df = spark.createDataFrame(rows, "s string, i int, known boolean")
    assert sorted(r.i for r in tables.streak_cut(df, ["s"], F.col("known"), 2, "i").collect()) == [0, 1, 2, 3]
    assert tables.tail_streak(df, ["s"], ~F.col("known"), 20, F.desc("i")).collect()[0].streak == 1


def test_clamped_fold_is_sequential(spark):
    df = spark.createDataFrame([(1, d, x) for d, x in enumerate([-5, 3, 40, -2])], "k int, d int, x int")
    assert tables.clamped_fold(df, ["k"], "d", "x", 0, 30).collect()[0].score == 28


def test_overlap_pairs_against_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = {i: sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 7))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "k int, t array<string>")
    classes: dict = {}
    for i, t in sets.items():
        classes.setdefault(tuple(t), i)
    reps = [(r, set(t)) for t, r in classes.items()]
    want = {(min(a, b), max(a, b)) for a, x in reps for b, y in reps if a < b and len(x & y) / max(len(x), len(y)) >= 0.62}
    got = {(min(r.left, r.right), max(r.left, r.right)) for r in tables.overlap_pairs(df, "k", "t", 0.62).collect()}
    assert got == want


def test_html_of_broken_markup():
    title, text, blocks, found, links, *_ = html.parse('<title>T &amp; U</title><script>var t="</p>";</script><h1>Head</h1><p>One<p>Two<table><tr><th>A<td>1</table><a href="/x">go</a>')
    assert title == "T & U" and "var t" not in text
    assert [b["heading"] for b in blocks if b["text"] in ("One", "Two")] == ["Head", "Head"]
    assert links == [{"href": "/x", "label": "go"}] and found
    assert html.parse(None)[1] == ""


def test_health_machine():
    at = pd.Timestamp("2024-01-01")
    assert health_step(2, None, at, "failure") == (3, at + pd.Timedelta(minutes=45))
    assert health_step(0, None, at, "429")[1] == at + dt.timedelta(minutes=60)
    assert health_step(5, at, at, "success") == (0, None)


def test_written_dates_and_deadlines(spark):
    assert value(spark, texts.written_dates(F.lit("le 3 Février 2024, 5 May 2024, 10 أبريل 2024, 31 juin 2024"))) == ["2024-02-03", "2024-05-05", "2024-04-10"]
    assert value(spark, texts.deadline(F.lit("Publié le 1/1/2024. Date limite : 15/02/2024 à 10:00"))) == "2024-02-15"
    assert value(spark, texts.deadline(F.lit("آخر أجل : 7 مارس 2024"))) == "2024-03-07"
    assert value(spark, texts.deadline(F.lit(None).cast("string"))) is None


def test_rewriting_markup(spark):
    table = "<table><tr><th>A</th><td>1</td></tr><tr><th>B</th><td> unknown </td></tr></table>"
    assert value(spark, html.without_empty_rows(F.lit(table))) == "<table><tr><th>A</th><td>1</td></tr></table>"
    links = F.array(F.struct(F.lit("/a").alias("href"), F.lit("A").alias("label")), F.struct(F.lit("/b?x=1&y").alias("href"), F.lit("<B>").alias("label")))
    assert value(spark, html.with_links(F.lit('<a href="/a">A</a>'), links, "More")) == '<a href="/a">A</a><h2>More</h2><ul><li><a href="/b?x=1&amp;y">&lt;B></a></li></ul>'


def test_global_circuit(spark):
    at = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "provider string, until string").withColumn("until", F.to_timestamp("until"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    shut = jobs.global_circuit(at("2024-01-01 13:00:00", "2024-01-01 12:30:00"), now).collect()[0]
    assert shut.open and str(shut.until) == "2024-01-01 12:30:00"
    assert not jobs.global_circuit(at("2024-01-01 13:00:00", None), now).collect()[0].open
    assert not jobs.global_circuit(at(), now).collect()[0].open


def test_numbers(spark):
    assert tuple(value(spark, numbers.salary_range(F.lit("de 8.000 à ١٢ ٥٠٠ DH")))) == (8000.0, 12500.0)
    assert value(spark, numbers.positions(F.lit("nombre de postes : 25"))) == 25
    assert value(spark, numbers.next_page(F.lit("https://x/?a=1&page=9#z"))) == "https://x/?a=1&page=10"
    assert value(spark, numbers.feed_links(F.lit('<link rel="alternate" type="application/rss+xml" href="/f.xml">'))) == ["/f.xml"]
    assert numbers.object_after('x = {"a": {"b": "}"}} tail', "x") == '{"a": {"b": "}"}}' and numbers.object_after("x = {", "x") is None


def test_tables_beyond_the_budget_are_left_out_and_never_merged():
    rows = lambda n, t: "".join(f"<tr><td>{t}.{i}</td></tr>" for i in range(n))
    page = "".join(f"<table>{rows(2, t)}</table>" for t in range(html.MOST_TABLES + 2))
    *_, found, _, truncated, _, _, _, _, _ = html.parse(page)
    assert found == [[[f"{t}.0"], [f"{t}.1"]] for t in range(html.MOST_TABLES)] and truncated
    *_, found, _, truncated, _, _, _, _, _ = html.parse(f"<table>{rows(html.MOST_ROWS + 3, 0)}</table><table>{rows(1, 1)}</table>")
    assert [len(t) for t in found] == [html.MOST_ROWS, 1] and found[0][-1] == [f"0.{html.MOST_ROWS - 1}"] and truncated
    *_, found, _, truncated, _, _, _, _, _ = html.parse("<table><tr>" + "".join(f"<td>{i}" for i in range(20)) + f"</tr><tr><td>{'x' * html.MOST_CHARS}</td></tr><tr><td>y</td></tr></table>")
    assert found == [[[str(i) for i in range(html.MOST_CELLS)]]] and truncated
    assert html.parse("<table><tr><td>a<table><tr><td>inner</table></td></tr></table>")[5] is False and html.parse(None)[1] == ""
