"""Queries of readers, sinks and the HTML parser, each beside its oracle.

The files that readers read and sinks write are made from the tables, in the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import local, texts, urls
from ..operators import facts, html, tables
from ..sources import readers, sinks
from ..streaming import jobs
from .catalogue import query, table
from .gate_queries import oracle
from .oracle import _HOST, _KEYWORDS, _PATH


def _lines(df: DataFrame, name: str, rows: int = 0) -> str:
    """Write the text column ``value`` as a folder of files, of so many rows each; its path."""
    path = jobs.scratch(df.sparkSession, name)
    df.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", rows).text(path)
    return path


def _document(rows: DataFrame, name: str, body: str) -> str:
    """Write one JSON document that has the rows' objects in an array (``body`` with ``%s``); its path."""
    # one document, as the format is one; the rows of a registry or of a queue are few
    whole = rows.agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("all"))
    head, tail = body.split("%s")
    return _lines(whole.select(F.concat(F.lit(head), F.col("all"), F.lit(tail)).alias("value")), name)


def _documents(rows: DataFrame, group: Column, name: str, body: str) -> str:
    """Write a JSON or XML document for each group of rows ``value``, a file each; their folder."""
    each = rows.withColumn("_g", group).groupBy("_g").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("all"))  # bounded groups
    head, tail = body.split("%s")
    return _lines(each.select(F.concat(F.lit(head), F.col("all"), F.lit(tail)).alias("value")), name, rows=1)


def _source():
    return F.to_json(F.struct(
        F.col("n_name").alias("name"), F.concat(F.lit("https://"), F.lower("n_name"), F.when(F.col("n_nationkey") % 6 == 0, F.lit("")).otherwise("/x/")).alias("base_url"),
        F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") % 2 == 0).alias("enabled"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("jobs")).alias("category_hint"), (F.col("n_nationkey") - 3).alias("fetch_limit_per_run"),
        F.when(F.col("n_nationkey") % 7 == 0, F.lit("Workday")).otherwise(F.when(F.col("n_nationkey") % 7 == 1, F.lit("inwi"))).alias("extractor_type"), F.when(F.col("n_nationkey") % 11 == 4, F.lit("https://f.example/rss")).alias("feed_url"),
    ))


def _registry(spark, sf_dir) -> str:
    """Nations as sources of the categories that are their regions."""
    nation = table(spark, sf_dir, "nation").withColumn("value", _source())
    per = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("sources"))  # 25 sources
    key = F.concat(F.when(F.col("n_regionkey") == 4, F.lit("news-")).otherwise("jobs-"), F.col("n_regionkey").cast("string"))
    category = per.select(F.concat(F.lit('{"key":"'), key, F.lit('","label":"Label '), F.col("n_regionkey").cast("string"), F.lit('","sources":['), F.col("sources"), F.lit("]}")).alias("value"))
    return _document(category, "registry", '{"categories":[%s]}')


@oracle("""select n_name as name, 'jobs-' || n_regionkey as category_key, case when n_nationkey % 3 = 0 then 'jobs' else 'Label ' || n_regionkey end as category_hint,
    case when n_nationkey % 11 = 4 then 'feed' when n_nationkey % 7 = 0 then 'api' when n_nationkey % 7 = 1 then 'listing' else 'general' end as reader from nation where n_regionkey <> 4""")
@query
def registry_sources(spark, sf_dir):
    """Sources of the job categories of a registry document, and what reads each."""
    return readers.dispatched(readers.registry(spark, _registry(spark, sf_dir))).select("name", "category_key", "category_hint", "reader")


@oracle("""with s as (select n_name as name, n_nationkey k from nation where n_regionkey <> 4) select name, 'enabled is neither true nor false' as reason from s where k % 5 = 0
    union all select name, 'unknown category' from s where k % 3 > 0 union all select name, 'limit is no positive integer' from s where k < 4""")
@query
def registry_lint(spark, sf_dir):
    return readers.lint(readers.registry(spark, _registry(spark, sf_dir)), ("jobs",))


@oracle("select c_custkey, (row_number() over (partition by c_custkey // 500 order by c_custkey) - 1)::int as position, c_name from customer")
@query
def queue_document(spark, sf_dir):
    """Rows of queue documents of up to 500 customers, with a byte order mark, beside corrupt ones that have none."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("a"), "c_custkey", "c_name")).alias("value"))
    good = readers.queue(spark, _documents(rows, F.floor(F.col("c_custkey") / 500), "queue", '﻿{"articles":[%s]}'), "c_custkey: bigint, c_name: string")
    bad = readers.queue(spark, _documents(rows, F.floor(F.col("c_custkey") / 500), "queue", '{"articles": [%s'), "c_custkey: bigint, c_name: string")
    return good.union(bad).select("c_custkey", "position", "c_name")


@oracle("""select ['ok', 'corrupt', 'invalid_shape'][g % 3 + 1] as status, count(*) as n from (select distinct c_custkey // 20 as g from customer) group by 1""")
@query
def storage_states(spark, sf_dir):
    """The states of queue documents of twenty customers each: whole, cut off, or of another shape."""
    group, name = F.floor(F.col("c_custkey") / 20), F.to_json(F.struct("c_name"))
    listed = table(spark, sf_dir, "customer").groupBy(group.alias("g")).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("all"), F.min(name).alias("one"))
    kind = F.col("g") % 3
    value = F.when(kind == 0, F.concat(F.lit('{"articles": ['), F.col("all"), F.lit("]}"))).when(kind == 1, F.concat(F.lit('{"articles": ['), F.col("all"))).otherwise(F.concat(F.lit('{"articles": '), F.col("one"), F.lit("}")))
    path = _lines(listed.select(value.alias("value")), "status", rows=1)
    return readers.storage_status(spark, path).groupBy("status").agg(F.count("*").alias("n"))


@oracle("""select c_custkey::varchar as campaign_id, 'k' || c_nationkey as semantic_key from customer where c_custkey % 4 <> 1 and c_custkey % 5 > 0 order by c_custkey desc limit 20""")
@query
def active_campaigns(spark, sf_dir):
    """The newest active campaigns of a folder of records."""
    key = F.col("c_custkey")
    record = F.to_json(F.struct(key.cast("string").alias("campaign_id"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("semantic_key"), F.when(key % 4 == 1, F.lit("closed")).otherwise(F.when(key % 4 == 2, F.lit("active"))).alias("status"),
                                F.when(key % 5 > 0, F.lit("https://x.example/")).alias("url"), F.lpad(key.cast("string"), 9, "0").alias("updated_at")))
    # an array of a thousand keys a file: a file for each record takes longer to make and list than all else
    path = _documents(table(spark, sf_dir, "customer").select("c_custkey", record.alias("value")), F.floor(key / 1_000), "campaigns", "[%s]")
    return readers.campaigns(spark, path, 20).select("campaign_id", "semantic_key")


@oracle("select event_id::varchar as run_id, event_type <> 'error' as success, user_id::int as candidates_found from events order by ts desc, event_id::varchar desc limit 100")
@query
def run_log_tail(spark, sf_dir):
    """The newest hundred runs of a log with junk lines."""
    run = F.to_json(F.struct(F.col("event_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("finished_at"), (F.col("event_type") != "error").alias("success"), F.col("user_id").cast("int").alias("candidates_found")))
    value = F.explode(F.array(run, F.lit("{junk")))
    return readers.run_log(spark, _lines(table(spark, sf_dir, "events").select(value.alias("value")), "log"), 100).select("run_id", "success", "candidates_found")


@oracle("select n_name as source, case when n_nationkey % 2 = 0 then timestamp '2024-01-05' end as last_crawled_at, 'ok' as status, n_nationkey::int as new_count from nation where n_nationkey % 3 > 0")
@query
def crawl_states(spark, sf_dir):
    """A keyed state document as rows; entries of another shape are left out."""
    entry = F.concat(F.lit('"'), F.col("n_name"), F.lit('":'), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit('{"last_crawled_at":"'), F.when(F.col("n_nationkey") % 2 == 0, F.lit("2024-01-05")).otherwise("never"), F.lit('","discovery_last_status":"ok","discovery_last_new_count":'), F.col("n_nationkey").cast("string"), F.lit("}"))).otherwise("null"))
    path = _document(table(spark, sf_dir, "nation").select(entry.alias("value")), "state", '{"sources":{%s}}')
    return readers.crawl_state(spark, path).withColumn("last_crawled_at", F.col("last_crawled_at").cast("timestamp_ntz"))


@oracle("""select 'https://x.example/' || (p_partkey // 3) as url, 'Part ' || min(p_partkey) as title, (p_partkey // 3) % 2 = 1 as atom from part group by p_partkey // 3""")
@query
def feed_items(spark, sf_dir):
    """Items of RSS and Atom files of up to 300 parts: links as text and as an attribute, the first of an address."""
    part = table(spark, sf_dir, "part").withColumn("n", F.floor(F.col("p_partkey") / 3))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_partkey").cast("int")), "yyyy-MM-dd")
    name, key = F.concat(F.lit("<title> Part  "), F.col("p_partkey").cast("string"), F.lit("</title>")), F.col("n").cast("string")
    item = F.concat(F.lit("<item>"), name, F.lit("<link>https://x.example/"), key, F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
    entry = F.concat(F.lit("<entry>"), name, F.lit('<link rel="self" href="https://s.example/"/><link href="https://x.example/'), key, F.lit('"/><id>i</id><updated>'), day, F.lit("</updated></entry>"))
    group = F.floor(F.col("p_partkey") / 300)
    rss = readers.feed(spark, _documents(part.filter("n % 2 = 0").select("p_partkey", item.alias("value")), group, "rss", "<rss><channel>%s</channel></rss>"), "item")
    atom = readers.feed(spark, _documents(part.filter("n % 2 = 1").select("p_partkey", entry.alias("value")), group, "atom", "<feed>%s</feed>"), "entry")
    return rss.select("url", "title", F.lit(False).alias("atom")).union(atom.select("url", "title", F.lit(True)))


@oracle("""select s_suppkey, c_custkey as campaign from supplier join customer on c_custkey = s_suppkey * 2 where c_custkey % 3 > 0""")
@query
def pointer_lookup(spark, sf_dir):
    """Two hops from an identity to its campaign; pointers to campaigns that are gone lead nowhere."""
    key = lambda c: F.concat(F.lit("i"), F.col(c).cast("string")).alias("identity_key")
    supplier = table(spark, sf_dir, "supplier")
    pointers = supplier.select(key("s_suppkey"), (F.col("s_suppkey") * 2).alias("campaign_id"))
    campaigns = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("campaign_id"))
    return readers.by_identity(supplier.select(key("s_suppkey"), "s_suppkey"), pointers, campaigns).select("s_suppkey", F.col("campaign_id").alias("campaign"))


@oracle("select s_nationkey as nation, c_custkey as campaign from (select distinct s_nationkey from supplier) join customer on c_nationkey = s_nationkey where c_custkey % 3 > 0")
@query
def semantic_lookup(spark, sf_dir):
    """All campaigns that an inverted index has for a key, those that are gone left out."""
    customer = table(spark, sf_dir, "customer")
    index = customer.groupBy(F.col("c_nationkey").alias("semantic_key")).agg(F.collect_list("c_custkey").alias("campaign_ids"))
    campaigns = customer.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("campaign_id"))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("semantic_key")).distinct()
    return readers.by_semantic(keys, index, campaigns).select(F.col("semantic_key").alias("nation"), F.col("campaign_id").alias("campaign"))


@oracle("""select event_id, n_name as source, n_regionkey as region from events join nation on user_id % 30 = n_nationkey where n_nationkey % 4 > 0""")
@query
def stamped_rows(spark, sf_dir):
    """Discovered rows with their source's columns; rows of unknown and disabled sources are left out."""
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), (F.col("n_nationkey") % 4 > 0).alias("enabled"), F.col("n_name").alias("category_hint"), F.col("n_regionkey").alias("extractor_type"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30).cast("string").alias("key"))
    return readers.stamped(rows, sources, "key", F.lit("2024-01-31").cast("timestamp")).select("event_id", F.col("category_hint").alias("source"), F.col("extractor_type").alias("region"))


# Sinks


@oracle("""select strftime(o_orderdate, '%Y-%m') as month, o_custkey, max(o_orderkey) as o_orderkey from orders group by all""")
@query
def monthly_archive(spark, sf_dir):
    """An archive written in two turns: a month keeps the rows of both."""
    path = jobs.scratch(spark, "archive")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate").cast("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0))).alias("d"))
    # the newest of a month is told by the order's key, as a microsecond within it: there are 2.4e12
    rows = rows.withColumn("at", F.timestamp_micros(F.unix_micros(F.date_trunc("month", "d")) + F.col("o_orderkey"))).drop("d")
    for odd in (0, 1):
        sinks.archive_by_month(rows.filter(F.col("o_orderkey") % 2 == odd), ["o_custkey"], "at", path)
    return spark.read.parquet(path).select(F.col("month").cast("string").alias("month"), "o_custkey", "o_orderkey")


@oracle("select true as first_written, true as same_skipped, true as change_written, count(*) + 1 as rows from nation")
@query
def unchanged_writes(spark, sf_dir):
    """A table written, written again unchanged, then with one row more, which it is read from meanwhile."""
    path, nation = jobs.scratch(spark, "state"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first = sinks.write_if_changed(nation, path, None)
    files = lambda: set(spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect())
    before = files()
    second = sinks.write_if_changed(nation.repartition(3), path, first)
    same = files() == before and second == first
    third = sinks.write_if_changed(spark.read.parquet(path).union(spark.createDataFrame([(99, "X")], "n_nationkey int, n_name string")), path, second)
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(bool(first)).alias("first_written"), F.lit(same).alias("same_skipped"), F.lit(third != second).alias("change_written"), "rows")


@oracle("""with c as (select o_custkey, max(o_orderdate) as t from orders where o_orderkey % 2 = 0 group by 1), n as (select o_custkey, max(o_orderdate) as t from orders where o_orderkey % 2 = 1 and o_custkey % 3 = 0 group by 1),
    b as (select * from c where o_custkey not in (select o_custkey from n) union all select * from n) select o_custkey from b where t >= timestamp '2001-08-20' - interval 180 day order by t desc, o_custkey limit 50""")
@query
def link_cache(spark, sf_dir):
    """A cache of links with newer rows in place of equal ones, without old ones, the newest fifty."""
    of = lambda condition: table(spark, sf_dir, "orders").filter(condition).groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return sinks.link_cache(of("o_orderkey % 2 = 0"), of("o_orderkey % 2 = 1 and o_custkey % 3 = 0"), "o_custkey", "at", "2001-08-20", 180, 50).select("o_custkey")


@oracle("select 25::bigint as queue, 24::bigint as cursors")
@query
def ordered_writes(spark, sf_dir):
    """A queue written whole before its cursors."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    paths = sinks.persist((nation, jobs.scratch(spark, "queue")), (nation.filter("n_nationkey > 0"), jobs.scratch(spark, "cursors")))
    counts = [spark.read.parquet(p).agg(F.count("*").alias(name)) for p, name in zip(paths, ("queue", "cursors"), strict=True)]
    return counts[0].join(F.broadcast(counts[1]))  # one row each


@oracle("""select o_orderkey, substr(sha256(o_orderkey || '|u' || o_custkey), 1, 24) as archive_key, concat_ws(',', 'o_orderpriority=' || o_orderpriority, case when o_orderkey % 2 = 0 then 'note=' || o_orderstatus end) as kept from orders""")
@query
def archive_records(spark, sf_dir):
    """Archive rows: their key, and the columns that are not empty."""
    rows = table(spark, sf_dir, "orders").withColumn("url", F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).withColumn("note", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(" "))
    found = sinks.compacted(rows, "o_orderkey", "url", ["o_orderpriority", "note"])
    shown = F.array_join(F.transform(F.map_entries("kept"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    key = F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "url"), 256), 1, 24)
    return found.join(rows.select("o_orderkey", key.alias("archive_key")), "archive_key").select("o_orderkey", "archive_key", shown.alias("kept"))


# Documents


def _pages(spark, sf_dir):
    """Pages of known markup, made of their numbers."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit("<html><head><title>Title "), n, F.lit('</title><meta name="description" content="About '), n, F.lit('"><meta property="article:published_time" content="2024-01-02">'), F.lit('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Job '), n, F.lit('","hiringOrganization":{"@type":"Organization","name":"O"}},{"@type":["Thing","Place"]}]}</script><script>var a = "</p>";</script></head><body>'))
    nav = F.lit("<nav><p>Home, products, services, contact and all that is in every menu</p></nav><div class='sidebar'><p>Newsletter of the week, subscribe now to have it always</p></div>")
    article = F.concat(F.lit("<article><h2>A heading of page "), n, F.lit(" here</h2><p>The first paragraph of page "), n, F.lit(" is long enough.<p>Short.</p><p>The first paragraph of page "), n, F.lit(" is long enough.</p><ul><li>An item of the list that is long enough as well</ul></article>"))
    tail = F.lit("<footer><p>All rights reserved by the owners of this page, always</p></footer></body></html>")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, nav, article, tail).alias("html"))


@oracle("""select page_id, 'A heading of page ' || page_id || ' here The first paragraph of page ' || page_id || ' is long enough. An item of the list that is long enough as well' as body, 'About ' || page_id as description, 'Title ' || page_id as title,
    epoch_us(timestamp '2024-01-02') as published_us from pages""")
@query
def article_bodies(spark, sf_dir):
    """The text of a page's container without what is around it, each part once; its title, description and time."""
    got = html.parsed(_pages(spark, sf_dir), "page_id", "html")
    return got.select("page_id", "body", "description", "title", F.unix_micros(local.published_time(F.lit(None).cast("string"), F.col("meta_time"), F.col("time_tag"))).alias("published_us"))


@oracle("""select page_id, unnest(['JobPosting', 'Organization', 'Thing,Place']) as type, unnest(['Job ' || page_id, null, null]) as title from pages""")
@query
def structured_nodes(spark, sf_dir):
    """All nodes of the structured data of every page, nested ones too."""
    nodes = html.parsed(_pages(spark, sf_dir), "page_id", "html").select("page_id", F.explode("nodes").alias("n"))
    return nodes.select("page_id", "n.type", F.get_json_object("n.json", "$.title").alias("title"))


@oracle("""select page_id, (row - 1)::int as row, 'r' || (row - 1) || 'c0,r' || (row - 1) || 'c1' as cells, page_id % 3 = 0 as truncated from pages, unnest(range(1, 121)) t(row) where page_id % 3 = 0 or row <= 3""")
@query
def table_budgets(spark, sf_dir):
    """Rows of tables within their budget of 120; the others are left out, and the page says so."""
    rows = F.when(F.col("page_id") % 3 == 0, 125).otherwise(3)
    line = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.concat(F.lit("<tr><td>r"), i.cast("string"), F.lit("c0<td> r"), i.cast("string"), F.lit("c1 </tr>")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<table>"), F.array_join(line, ""), F.lit("</table><nav><table><tr><td>x</td></tr></table></nav>")).alias("html"))
    got = html.parsed(pages, "page_id", "html").select("page_id", "truncated", F.posexplode(F.flatten("tables")).alias("row", "c"))
    return got.select("page_id", "row", F.array_join("c", ",").alias("cells"), "truncated")


@oracle("""select page_id, unnest(['deadline', 'positions', 'positions']) as category, unnest(['2024-03-01', '12', page_id::varchar]) as value, unnest(['table_column', 'table_column', 'table_label']) as origin from pages where page_id <> 12
    union all select 12, 'deadline', '2024-03-01', 'table_column' where exists (select 1 from pages where page_id = 12) union all select 12, 'positions', '12', 'table_label' where exists (select 1 from pages where page_id = 12)""")
@query
def table_evidence(spark, sf_dir):
    """Facts of a page's tables, by column and by label, each value once."""
    n = F.col("page_id").cast("string")
    page = F.concat(F.lit("<table><tr><th>Post<th>Number of posts<th>Deadline</tr><tr><td>Driver<td>12<td>2024-03-01</tr></table><table><tr><td>Number of posts:</td><td>"), n, F.lit("</td></tr></table>"))
    got = html.parsed(table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_id", "html")
    found = facts.best(facts.from_tables(got, "page_id", "tables", {"positions": "(?i)number of posts", "deadline": "(?i)deadline"}), "page_id")
    return found.select("page_id", "category", "value", "origin")


@oracle(f"""with k as (select page_id, {_HOST} || {_PATH} as key from pages), e as (select distinct a.key as src, b.key as dst from k a join k b on b.page_id = a.page_id + 1 where a.key <> b.key) select src, dst from e""")
@query
def page_links(spark, sf_dir):
    """Edges between known pages, from the anchors of pages that link to the next one, to themselves and elsewhere."""
    pages = table(spark, sf_dir, "pages")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    hrefs = F.array_compact(F.array(F.concat(F.col("next"), F.lit("#a")), F.concat("url", F.lit("#top")), F.lit("https://elsewhere.example/")))
    rows = pages.join(following, "page_id", "left").select("url", hrefs.alias("hrefs"))
    return tables.anchors(rows, "url", "hrefs", urls.link_key)


# Similarity


@oracle(f"""with k as (select doc_id, list_sort(kw) t from ({_KEYWORDS})), r as (select t, min(doc_id) rep from k group by 1),
    l as (select a.rep, count(*) n from r a join r b on a.rep <> b.rep and len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) >= 0.62 group by 1)
    select doc_id, r.rep, coalesce(n, 0)::bigint as links from k join r using (t) left join l on l.rep = r.rep""")
@query
def topic_classes(spark, sf_dir):
    """Every titled document's class of equal keywords, and how many classes are similar to it."""
    titled = table(spark, sf_dir, "documents").select("doc_id", texts.topic_keywords(texts.first_line(F.col("text"))).alias("tokens"))
    pairs = tables.overlap_pairs(titled, "doc_id", "tokens", 0.62, marked="^cve-")
    return tables.linked_classes(titled, "doc_id", "tokens", pairs)
