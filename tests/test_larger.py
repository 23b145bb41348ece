"""Registered queries against their oracles on rows that the given tables do not have: equal numbers, large keys, more records."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.operators import facts, gates, html
from sievewright.plans import catalogue, collect_queries, field_queries, io_queries, oracle, quality_queries  # noqa: F401
from sievewright.sources import collector

SF = "/root/testdata/sf0.001"


def same(spark, name, tmp_path, **tables):
    """Whether a query gives its oracle's rows on these tables (SQL over those at ``SF``)."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"copy ({sql.format(t=f'{SF}/{table}.parquet')}) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    want = con.sql(oracle.SQL[name])
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(want.columns)
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    return rows(got.collect()) == rows(want.fetchall())


def test_a_number_that_is_not_one_of_posts_is_no_fact_of_positions(spark, tmp_path):
    assert same(spark, "line_facts", tmp_path, supplier="select s.* replace (s_nationkey + 0.5 as s_acctbal) from '{t}' s")
    texts = spark.createDataFrame([("in rabat 12", False), ("with 12 posts", True), ("112 posts", False), ("1 200 posts", False), ("12 postes à Fès", True), ("12 posters", False)], "text string, has boolean")
    got = texts.select("has", facts.present(F.col("text"), F.lit("positions"), F.lit("12")).alias("found")).collect()
    assert all(r.has == r.found for r in got)


def test_the_archive_keeps_the_largest_key_beyond_two_million(spark, tmp_path):
    assert same(spark, "monthly_archive", tmp_path, orders="select o.* replace (o_orderkey + i * 1_999_000 as o_orderkey) from '{t}' o, range(3) r(i)")


def test_campaigns_of_many_records_are_few_files(spark, tmp_path, monkeypatch):
    written = []
    whole = io_queries._lines
    monkeypatch.setattr(io_queries, "_lines", lambda *a, **k: written.append(whole(*a, **k)) or written[-1])
    assert same(spark, "active_campaigns", tmp_path, customer="select c.* replace (c_custkey + i * 150 as c_custkey) from '{t}' c, range(20) r(i)")
    assert len(spark.read.format("binaryFile").load(written[0]).select("path").collect()) <= 4


def test_a_batch_is_parsed_in_slices():
    texts = ["x" * 10] * 700 + ["y" * (1 << 19)] * 5 + [None, ""]
    parts = list(html.slices(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "html"]), 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert max(p.num_rows for p in parts) <= html.SLICE and max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts) < 2 * html.SLICE_CHARS
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["id", "html"])
    assert [p.num_rows for p in html.slices(empty, 1)] == [0]


def test_blocks_of_one_place_in_two_regions_are_two_pairs(spark):
    words = "five words that say something 12-34"
    rows = [(1, 1, "a", words), (1, 2, "b", words), (1, 2, "c", words), (1, 3, "a", "four other words here entirely"), (2, 2, "b", words)]
    found = gates.repeated_blocks(spark.createDataFrame(rows, "doc int, pos int, region string, text string"), "doc", "pos", "region", "text")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2, 5), (1, 1, 2, 5)]


@pytest.mark.parametrize("name", ["table_facts", "extracted_fields"])
def test_pages_are_parsed_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_long_backlog_is_walked_in_a_bounded_number_of_runs(spark, tmp_path, monkeypatch):
    runs, rounds = [], []
    run, ended = collector.run, collector._ended
    monkeypatch.setattr(collector, "run", lambda *a: runs.append(1) or run(*a))
    monkeypatch.setattr(collector, "_ended", lambda *a: rounds.append(1) or ended(*a))
    assert same(spark, "collected_pages", tmp_path, events="select e.* replace (event_id + i * 1_000_000 as event_id) from '{t}' e, range(40) r(i)")
    assert len(runs) == 1 and len(rounds) <= 3


def test_walks_from_several_places_are_those_from_one(spark, tmp_path):
    fetch = lambda source, cursor: ([(f"{source}{cursor}-{i}", "{}") for i in range(0 if (source, cursor) == ("b", "10") else 3)], str(int(cursor) + 1) if int(cursor) < 10 else None)
    rules = collector.Rules(page_size=3, max_pages=4, max_items=7, streak=3)
    known = spark.createDataFrame([("a", f"a{p}-{i}") for p in (1, 2, 5) for i in range(3)], "source string, id string")
    walked = lambda name, walks: sorted(map(tuple, collector.backlog(spark, fetch, spark.createDataFrame(walks, collector.WALKS), known, f"{tmp_path}/{name}", rules).collect()))
    one = walked("one", [(s, "backlog", "0", None) for s in "ab"])
    want = sorted((s, "backlog", str(p), i, f"{s}{p}-{i}", "{}") for s in "ab" for p in range(11) for i in range(3) if not (s == "a" and p in (1, 2, 5)) and (s, p) != ("b", 10))
    assert one == want
    assert walked("more", [(s, "backlog", str(p), str(p + 4)) for s in "ab" for p in (0, 4, 8)]) == want
    assert {r[2] for r in walked("head", [("a", "head", "0", None)])} == {"0"}  # its second page is known


def test_an_address_is_parsed_a_few_times_and_not_once_for_each_mention(spark):
    from sievewright.functions import keys, urls

    url = F.col("u")
    df = spark.createDataFrame([("http://WWW.A.ma//x%41/jobs/1234/?b=2&a=1&ref=z#f",), (None,), ("by post",)], "u string")
    got = df.select(urls.canonical_job(url).alias("c"), keys.is_job_specific(urls.canonical_job(url)).alias("s"), keys.is_foreign_detail(urls.canonical_job(url), urls.canonical_job(url)).alias("f"))
    assert [tuple(r) for r in got.collect()] == [("https://a.ma/xA/jobs/1234?a=1&b=2", True, False), ("", False, False), ("by post", False, False)]
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract(") < 80


@pytest.mark.parametrize("name", ["publication_quality", "arabic_slugs", "rewritten_pages", "listing_next"])
def test_a_small_file_of_costly_rows_is_many_tasks(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan


def test_the_gate_reads_a_page_once(spark):
    plan = catalogue.QUERIES["publication_quality"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(script|style)") <= 3  # the page, its headings, its cells
