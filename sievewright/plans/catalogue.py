"""The registered queries: each operator over a fixture table, with production semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons, ladders, texts, times, urls
from ..operators import facts, html, identity, reports, schedule, tables
from ..sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The queries' ``now``: no query reads the clock.
NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-09-01 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Four tasks for each core: a file of few bytes is read by one, whatever is computed of each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _now(text: str = NOW):
    return F.lit(text).cast("timestamp")


def _day(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd")


# URLs


@query
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query
def job_url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_job(F.col("url")).alias("canonical"), urls.link_key(F.col("url")).alias("link_key"))


@query
def url_reference(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.reference(url).alias("reference"), urls.is_specific(url).alias("specific"))


@query
def url_dedup_keep_first(spark, sf_dir):
    """Canonical address, first page of each, pages by host."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.canonical_job(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"))
    return tables.keep_first(pages, ["canonical"], "page_id").groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query
def host_rotation(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.max("page_id").alias("last_page"))


@query
def likely_articles(spark, sf_dir):
    """Pages that link filters keep, taking the page's host as the site."""
    pages = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return pages.filter(urls.is_likely_article(F.col("title"), F.col("url"), F.col("url"))).select("page_id", F.trim("title").alias("title"))


# Texts


@query
def title_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.title_hash(texts.first_line(F.col("text"))).alias("title_hash"))


@query
def topic_keywords(spark, sf_dir):
    title = texts.first_line(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.topic_keywords(title), " ").alias("keywords"))


@query
def topic_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.topic_signature(texts.first_line(F.col("text"))).alias("signature"))


@query
def content_hash_dups(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").groupBy(texts.content_hash(F.col("text")).alias("content_hash"))
    return hashed.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.word_count(F.col("text")).alias("words"))


@query
def repeated_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(texts.has_repeated_blocks(F.col("text"))).select("doc_id")


@query
def secret_redact(spark, sf_dir):
    text = F.regexp_replace("text", "token = ", "access_token: ")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(texts.redact(text)).alias("redacted"))


@query
def failure_fingerprint(spark, sf_dir):
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'")
    reason = F.concat(F.lit("Timeout after "), F.col("event_id").cast("string"), F.lit("s at https://x.example/a?id="), F.col("user_id").cast("string"))
    return failed.groupBy(texts.failure_fingerprint(F.col("event_type"), reason).alias("fingerprint")).agg(F.count("*").alias("n"))


@query
def dates_in_text(spark, sf_dir):
    """Numeric dates, from order dates written in two forms."""
    orders = table(spark, sf_dir, "orders")
    written = F.concat(F.lit("from "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" to "), F.date_format("o_orderdate", "yyyy-M-d"), F.lit(" or 31/02/2001"))
    return orders.select("o_orderkey", F.array_join(texts.dates(written), " ").alias("dates"))


@query
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


@query
def language_mix(spark, sf_dir):
    """Whole percent of letters that are Latin."""
    share = F.floor(texts.script_share(F.col("text"), "Latin") * 100).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", share.alias("latin_percent"))


# Joins and merges


@query
def merge_non_blank(spark, sf_dir):
    """Customers, segment replaced by the newest order's priority unless blank."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    orders = table(spark, sf_dir, "orders")
    newest = tables.top_k(orders, ["o_custkey"], 1, F.desc("o_orderdate"), F.desc("o_orderkey"))
    label = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" ")).otherwise(F.col("o_orderpriority"))
    return tables.upsert_non_blank(customer, newest.select(F.col("o_custkey").alias("c_custkey"), label.alias("label")), "c_custkey", ["label"])


@query
def source_anti_join(spark, sf_dir):
    return tables.anti_by_any(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query
def recovery_anti_join(spark, sf_dir):
    """Suppliers with neither a line of theirs returned nor a customer of their number without balance."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("a"))
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("b"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    return tables.anti_by_any(tables.anti_by_any(supplier, returned, [("s_suppkey", "a")]), poor, [("s_suppkey", "b")])


@query
def post_merge_precedence(spark, sf_dir):
    """Purchases override signups by user; either flag counts."""
    events = table(spark, sf_dir, "events")
    of = lambda kind: tables.top_k(events.filter(F.col("event_type") == kind), ["user_id"], 1, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", F.lit(kind == "purchase").alias("bought"))
    return tables.outer_merge(of("purchase"), of("signup"), "user_id", "event_id", "bought")


@query
def interval_unique_match(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return tables.interval_unique(events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'"), "user_id", "ts", 30, "event_id", "event_id")


@query
def all_failed_sources(spark, sf_dir):
    """Users and days whose events all failed."""
    events = table(spark, sf_dir, "events").select("user_id", _day().alias("day"), (F.col("event_type") == "error").alias("failed"))
    return tables.all_failed(events, ["user_id", "day"], F.col("failed"))


@query
def similar_topic_pairs(spark, sf_dir):
    """Classes of titles that share 0.62 of the larger's keywords, or any with a CVE number; ``topic_classes`` has the members."""
    titled = table(spark, sf_dir, "documents").select("doc_id", texts.topic_keywords(texts.first_line(F.col("text"))).alias("tokens"))
    return tables.overlap_pairs(titled, "doc_id", "tokens", 0.62, marked="^cve-")


@query
def related_top3(spark, sf_dir):
    """For every part the three most related of its brand: type 8, size 4, name 2."""
    return tables.related(table(spark, sf_dir, "part"), "p_partkey", "p_brand", {"p_type": 8, "p_size": 4, "p_name": 2}, 3).withColumnRenamed("p_partkey", "part")


# Scores, gates, ranking


def _orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    age = F.datediff(_now(ORDERS_NOW), F.col("o_orderdate"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("age_days", age)


@query
def score_clamped(spark, sf_dir):
    total = F.col("o_totalprice")
    indicators = {
        "official": F.col("o_orderstatus") == "F",
        "fresh": F.col("age_days") <= 365,
        "very_fresh": F.col("age_days") <= 90,
        "focus": F.col("c_mktsegment").isin("MACHINERY", "BUILDING"),
        "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "many_positions": total >= 400_000,
        "deadline": F.col("o_orderstatus") != "P",
        "location": F.col("c_nationkey") < 5,
        "salary": F.col("c_acctbal") > 5_000,
    }
    return _orders(spark, sf_dir).select("o_orderkey", ladders.score(indicators).cast("int").alias("score"))


@query
def gate_reasons(spark, sf_dir):
    found = ladders.reasons(
        (F.col("o_orderstatus") == "P", "pending"),
        (F.col("age_days") > 1_500, "stale"),
        (F.col("c_acctbal") < 0, "debt"),
        (F.col("o_totalprice") < 10_000, "small"),
    )
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(found, ",").alias("reasons"), (F.size(found) == 0).alias("passed"))


@query
def urgency_ladder(spark, sf_dir):
    days = F.col("age_days") - 1_000
    notice = F.when(F.col("o_orderstatus") == "P", "result").otherwise("vacancy")
    level = ladders.urgency(notice, F.col("o_orderpriority") != "5-LOW", days, (F.col("o_totalprice") / 4_000).cast("int"))
    return _orders(spark, sf_dir).groupBy(level.alias("urgency")).agg(F.count("*").alias("n"))


@query
def intake_buckets(spark, sf_dir):
    score = ladders.intake_score(F.col("s_acctbal") > 0, F.element_at(F.array(*map(F.lit, ("S+", "S", "A+", "A", "B"))), (F.col("s_suppkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").groupBy(ladders.intake_bucket(score).alias("bucket")).agg(F.count("*").alias("n"), F.sum(score).cast("long").alias("points"))


@query
def fair_select_topk(spark, sf_dir):
    """The best open order of every nation: priority, then least recently served, then newest."""
    orders = _orders(spark, sf_dir)
    served = orders.filter("o_orderstatus = 'F'").groupBy(F.col("c_nationkey").alias("_n")).agg(F.max("o_orderdate").alias("served"))
    ready = orders.filter("o_orderstatus = 'O'").join(served, F.col("c_nationkey") == F.col("_n"), "left")
    best = tables.top_k(ready, ["c_nationkey"], 1, "o_orderpriority", F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey")
    return best.select("c_nationkey", "o_orderkey", F.date_format("served", "yyyy-MM-dd").alias("served"))


@query
def social_priority(spark, sf_dir):
    hours = (F.col("age_days") - 1_200) * 24
    due = ladders.deadline_points(F.when(hours >= 0, hours))
    boost = F.when(F.col("o_orderpriority") == "1-URGENT", 8).when(F.col("o_orderpriority") == "2-HIGH", 6).otherwise(0)
    ranked = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", (due + boost).alias("points"))
    return tables.top_k(ranked, ["o_custkey"], 1, F.desc("points"), "o_orderkey")


@query
def batch_top12(spark, sf_dir):
    ready = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    picked = ready.orderBy("o_orderpriority", F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").limit(12)
    return picked.select("o_orderkey", "o_orderpriority")


@query
def round_robin(spark, sf_dir):
    return tables.round_robin(table(spark, sf_dir, "documents"), "source", 60, "doc_id").select("doc_id", "source", "turn")


@query
def best_confidence_dedup(spark, sf_dir):
    """For each source and quality the longest labelled document, at the first one's place."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "quality", "doc_id", "n_chars")
    return tables.keep_best(labelled, ["source", "quality"], F.col("n_chars"), "doc_id")


# Aggregates


@query
def daypart_engagement(spark, sf_dir):
    """Mature events by part of the day: parts with three samples of two days, and their mean."""
    hour = F.hour("ts")
    part = F.when(hour < 8, "overnight").when(hour < 12, "morning").when(hour < 17, "midday").otherwise("evening")
    mature = table(spark, sf_dir, "events").filter((times.seconds_between(F.col("ts"), _now()) >= 86_400) & (F.col("event_type") != "error"))
    return reports.engagement(mature, [part.alias("daypart")], "value", 1, _day()).filter("samples >= 3 and days >= 2")


@query
def daytype_period(spark, sf_dir):
    """Purchases by kind of day and period: whether a cell has enough, its mean, and whether two cells have."""
    hour = F.hour("ts")
    kind = F.when(F.weekday("ts") < 5, "weekday").otherwise("weekend")
    period = F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")
    cells = reports.engagement(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), [kind.alias("daytype"), period.alias("period")], "value", 2, _day())
    return reports.with_flag(cells.withColumn("enough", F.col("samples") >= 4), "enough", 2, "recommend")


@query
def blocker_top10(spark, sf_dir):
    labels = ladders.reasons(
        (F.col("l_returnflag") == "R", "returned"),
        (F.col("l_linestatus") == "O", "open"),
        (F.col("l_discount") > 0.08, "discounted"),
        (F.col("l_quantity") > 45, "bulk"),
        (F.col("l_tax") == 0, "untaxed"),
    )
    return tables.histogram(table(spark, sf_dir, "lineitem"), labels, 10)


@query
def category_zero_fill(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900")
    return tables.zero_filled(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), rich, "n_nationkey", "c_nationkey")


@query
def consensus_value(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("tax", F.round(F.col("l_tax") * 100).cast("int"))
    return tables.consensus(lines, ["l_orderkey"], "tax", F.lit(0))


@query
def coverage_status(spark, sf_dir):
    """Suppliers without recent lines, and the nation's state."""
    recent = F.max(F.when(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"), 1).otherwise(0))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("_s")).agg(recent.alias("recent"), F.count("*").alias("lines"))
    both = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("_s"), "left")
    per = both.groupBy("s_nationkey").agg(F.count("*").alias("enabled"), F.sum(F.coalesce("recent", F.lit(0))).alias("recent"), F.sum(F.coalesce("lines", F.lit(0))).alias("discoveries"))
    state = ladders.coverage(F.lit(400), F.when(F.col("recent") > 1, 1).otherwise(0), F.col("discoveries"), F.lit(0), F.col("enabled"), F.col("recent"))
    return per.select("s_nationkey", "enabled", "recent", state.alias("state"))


@query
def daily_cap_window(spark, sf_dir):
    """Purchases a day: number, last one, and whether another is allowed under a cap of 60."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    daily = bought.groupBy(_day().alias("day")).agg(F.count("*").alias("n"), F.max(times.micros(F.col("ts"))).alias("last_us"))
    return daily.withColumn("allowed", F.col("n") < 60)


@query
def archive_by_month(spark, sf_dir):
    monthly = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return monthly.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"), F.countDistinct("o_custkey").alias("customers"))


@query
def props_json(spark, sf_dir):
    key = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy(key.alias("k")).agg(F.count("*").alias("n"))


# Sequences and state


@query
def seen_streak_cut(spark, sf_dir):
    """Each user's events until three views in a row."""
    return tables.streak_cut(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "view", 3, "ts", "event_id").select("user_id", "event_id", "streak")


@query
def empty_streak_tail(spark, sf_dir):
    return tables.tail_streak(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type").isin("error", "view"), 20, F.desc("ts"), F.desc("event_id"))


@query
def clamped_fold(spark, sf_dir):
    """Each user's daily health, folded into a score of 0 to 30."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    daily = table(spark, sf_dir, "events").groupBy("user_id", _day().alias("day")).agg(n("error").alias("failed"), n("purchase").alias("bought"), n("view").alias("viewed"))
    health = ladders.day_health(F.lit(0), F.col("failed"), F.lit(0), F.col("viewed") * 2, F.lit(0), F.col("bought") + F.col("viewed") + 1)
    return tables.clamped_fold(daily.withColumn("delta", health["delta"]), ["user_id"], "day", "delta", 0, 30)


@query
def repeat_backoff(spark, sf_dir):
    """Minutes of backoff after each error of a run of errors."""
    from pyspark.sql import Window

    events = tables.islands(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error", "ts", "event_id")
    failed = events.filter("event_type = 'error'")
    nth = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return failed.select("event_id", nth.alias("nth")).withColumn("minutes", times.backoff(15, F.col("nth"), 7, 1440).cast("int"))


@query
def late_data_split(spark, sf_dir):
    """Events by whether they are in their kind's freshness limit."""
    kinds = F.create_map(*map(F.lit, ("click", "job", "view", "internship", "signup", "training", "purchase", "scholarship", "error", "apprenticeship")))
    known = times.freshness(F.col("ts").cast("timestamp"), F.col("user_id") % 2 == 0, kinds[F.col("event_type")], _now())
    return table(spark, sf_dir, "events").groupBy("event_type", known["fresh"].alias("fresh")).agg(F.count("*").alias("n"))


@query
def retention_prune(spark, sf_dir):
    return tables.keep_newest(table(spark, sf_dir, "events"), ["user_id"], 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query
def age_band_sample(spark, sf_dir):
    bands = {"early": (1, 8), "day": (24, 48), "week": (168, 216)}
    age = (times.micros(_now()) - times.micros(F.col("ts"))) / 3_600_000_000
    return tables.age_bands(table(spark, sf_dir, "events"), ["user_id"], age, bands, "event_id").select("user_id", "band", "event_id")


# Documents and graphs


@query
def html_text_words(spark, sf_dir):
    return html.parsed(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", texts.word_count(F.col("text")).alias("words"))


@query
def section_blocks(spark, sf_dir):
    return html.parsed(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.heading", "b.text")


@query
def table_facts(spark, sf_dir):
    """Each customer's orders as a table of a page, with a header, and a table of labels, parsed and read as facts."""
    order = F.struct("o_orderkey", F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("<td> "), F.col("o_orderpriority"), F.lit(" </td><td>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</tr>")).alias("row"))
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["row"]), "\n").alias("rows"))
    customers = table(spark, sf_dir, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"))
    page = F.concat(
        F.lit("<html><body><nav><table><tr><td>Priority<td>none</table></nav><table><thead><tr><th>No<th>Priority<th>Due</thead>"), F.col("rows"),
        F.lit("</table><table><tr><th>Segment</th><td>"), F.col("c_mktsegment"), F.lit("</td></tr><tr><td>Other<td>x</table>"),
    )
    parsed = html.parsed(customers.select("c_custkey", page.alias("page")), "c_custkey", "page")
    return facts.from_tables(parsed, "c_custkey", "tables", {"priority": "^Priority$", "due": "^Due$", "segment": "^Segment$"})


@query
def link_degree_orphans(spark, sf_dir):
    """Degrees in the graph of hosts: a page's host leads to the host of its own address without a sub-domain."""
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"))
    edges = pages.select(F.col("host").alias("src"), F.regexp_replace("host", r"^(?:m|blog)\.", "").alias("dst"))
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    return tables.degrees(edges, nodes, "host")


@query
def identity_resolution(spark, sf_dir):
    """Odd orders as articles against even ones as campaigns."""
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    shaped = orders.select(
        F.col("o_orderkey").alias("key"),
        F.concat_ws(":", "o_custkey", F.year("o_orderdate"), "o_orderstatus").alias("identity_key"),
        F.concat_ws(":", "o_custkey", "o_orderstatus").alias("semantic_key"),
        F.col("o_orderpriority").alias("reference"),
        F.concat(F.lit("http://www.h"), (F.col("o_orderkey") % 6 / 2).cast("int").cast("string"), F.lit(".example/jobs/"), F.col("o_custkey").cast("string"), F.lit("/")).alias("apply_url"),
        day.alias("posted"),
        F.date_add(day, 30).alias("deadline"),
        F.floor(F.col("o_totalprice") / 50_000).cast("int").alias("positions"),
        F.lit(None).cast("string").alias("salary"),
        F.concat_ws("-", "o_orderstatus", F.col("o_orderkey") % 4 < 2).alias("signature"),
        (F.col("o_orderkey") % 7).cast("int").alias("strength"),
        (F.col("o_orderkey") % 5 != 0).alias("complete"),
    )
    articles = shaped.filter("key % 2 = 1").withColumnRenamed("key", "article_id")
    return identity.resolve(articles, shaped.filter("key % 2 = 0").withColumnRenamed("key", "campaign_id"))


@query
def posting_documents(spark, sf_dir):
    """A posting of every part, and what keeps it from being valid."""
    given = {
        "title": F.col("p_name"),
        "company": F.when(F.col("p_partkey") % 7 == 0, F.lit(" ")).otherwise(F.col("p_brand")),
        "posted": F.lit("2024-01-01"),
        "location": F.when(F.col("p_size") > 40, F.lit("")).otherwise(F.col("p_type")),
        "deadline": F.when(F.col("p_size") > 25, F.lit("2024-03-01")).otherwise(F.lit("2024-01-15")),
    }
    errors = jsons.posting_errors(given, _now())
    document = jsons.posting(given["title"], given["company"], given["posted"], given["location"], given["deadline"], F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha1(document).alias("document"), F.array_join(errors, ",").alias("errors"))


@query
def reply_repair(spark, sf_dir):
    """Fenced replies made from event properties: the value that the repair gives."""
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).otherwise(F.lit("none"))
    value = F.try_variant_get(jsons.repaired(reply), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"), F.array_join(jsons.missing_keys(reply, ("k",)), ",").alias("missing"))


@query
def line_facts(spark, sf_dir):
    """Facts written as labelled lines for every supplier, and those that a shorter text lacks."""
    text = F.concat(F.lit("Posts: "), F.floor("s_acctbal").cast("string"), F.lit("\nCity :  Rabat "), F.col("s_nationkey").cast("string"), F.lit("\nfree text"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))
    found = facts.best(facts.from_lines(suppliers, "s_suppkey", "text", {"positions": "^Posts", "location": "^City"}), "s_suppkey")
    output = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("in rabat "), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("with "), F.floor("s_acctbal").cast("string"), F.lit(" posts")))
    outputs = table(spark, sf_dir, "supplier").select("s_suppkey", output.alias("output"))
    lacks = facts.missing(found, outputs, "s_suppkey", "output", ("positions",))
    return lacks.select("s_suppkey", F.array_join("blocking", ",").alias("blocking"), F.array_join("warnings", ",").alias("warnings"))


@query
def semantic_index(spark, sf_dir):
    """The last three even orders of each customer, with one odd order more."""
    orders = table(spark, sf_dir, "orders")
    held = orders.filter("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    more = orders.filter("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("one"))
    return sinks.append_semantic(held, more, "k", "ids", "one", 3).select("k", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query
def budgeted_rows(spark, sf_dir):
    """Turns of each conversation while they fit 1,000 characters together."""
    turns = table(spark, sf_dir, "conversations")
    return readers.within_budget(turns, ["conv_id"], F.char_length("text"), 1_000, "turn", "role", "text").select("conv_id", "turn")


@query
def listing_links(spark, sf_dir):
    """Links of every page that the general filter keeps."""
    return readers.listing(table(spark, sf_dir, "pages"), "page_id", "html", "url").select("page_url", "title", "url", "reference")


@query
def log_tail(spark, sf_dir):
    """The newest 672 events as a bounded log, new ones appended."""
    events = table(spark, sf_dir, "events").select("event_id", times.micros(F.col("ts")).alias("us"))
    return sinks.bounded_log(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), 672, "us", "event_id").select("event_id")


@query
def weekly_slots(spark, sf_dir):
    """Purchases by 50-minute slot of the week, and the next slot that has one, over the end of the week too."""
    slot = F.floor((F.weekday("ts") * 1440 + F.hour("ts") * 60 + F.minute("ts")) / 50).cast("int")
    counted = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    return schedule.following(counted, "slot", 202, "next_slot")
