"""Queries of keys, classifiers, local time, policies and reports, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, jsons, keys, ladders, local, texts, times, urls
from ..operators import gates, reports, schedule, tables
from ..streaming import jobs
from .catalogue import _now, query, table
from .gate_queries import oracle
from .oracle import _HOST, _PATH, SQL


def _pick(n, *values):
    """A literal by the remainder of a number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql(n: str, *values: str) -> str:
    """The same in SQL."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][({n}) % {len(values)} + 1]"


def _cases(n: str, *results: str) -> str:
    return f"[{', '.join(results)}][({n}) % {len(results)} + 1]"


# Addresses and keys


@oracle("""select page_id, 'https://www.x.example/caf%C3%A9/%C3%A9%20x/' || page_id || '?b=A+z&c=%C3%A9&a=1+2' as canonical, 'https://x.example/caf%C3%A9/%C3%A9%20x/' || page_id || '?a=1+2&b=A+z&c=%C3%A9' as job,
    'x.example/caf%C3%A9/%C3%A9%20x/' || page_id as link_key from pages""")
@query
def url_escapes(spark, sf_dir):
    """Addresses whose escapes, spaces and letters are spelled in several ways."""
    url = F.concat(F.lit("HTTPS://WWW.X.example//caf%c3%a9/"), _pick(F.col("page_id"), "é x", "%C3%A9%20x", "%c3%a9 x"), F.lit("/"), F.col("page_id"), F.lit("/;p?b=%41%20z&utm_source=q&c=é&a=1+2#f"))
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(url).alias("canonical"), urls.canonical_job(url).alias("job"), urls.link_key(url).alias("link_key"))


_SPECIFIC = ("https://a.example/jobs/123", "https://a.example/jobs/", "https://a.example/", "https://a.example/search?id=777", "https://a.example/careers/engineer/apply", "https://a.example/one", "ftp://a.example/jobs/123", "https://a.example/x/deadbeef")


@oracle(f"select p_partkey, {_cases('p_partkey', 'true', 'false', 'false', 'true', 'true', 'false', 'false', 'true')} as specific from part")
@query
def specific_urls(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", keys.is_job_specific(_pick(F.col("p_partkey"), *_SPECIFIC)).alias("specific"))


@oracle("""with s as (select *, regexp_replace(lower(s_name), '[^a-z0-9_]+', ' ', 'g') n from supplier),
    k as (select s_suppkey, n || '|job ' || s_nationkey || '|' || case when s_suppkey % 2 = 0 then 'rabat' else '' end as core, case s_suppkey % 4 when 0 then 'ref|' || n || '|ab ' || s_suppkey
      when 1 then 'url|https://x.example/jobs/' || (1000 + s_suppkey) when 2 then 'apply|https://y.example/apply-here/' || (2000 + s_suppkey) end as own from s)
    select s_suppkey, substr(sha256(coalesce(own, 'core|' || core)), 1, 24) as identity_key, substr(sha256(core), 1, 20) as semantic_key from k""")
@query
def identity_keys(spark, sf_dir):
    """Keys by reference, own address, application address and core facts, by turns."""
    n, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    core = keys.core_key(F.col("s_name"), F.concat(F.lit("Job  "), "s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("Rabat")))
    reference = F.when(n == 0, F.concat(F.lit(" AB-"), key))
    url = F.when(n == 1, F.concat(F.lit("http://www.x.example/jobs/"), (F.col("s_suppkey") + 1000).cast("string"), F.lit("?utm_source=a"))).otherwise("https://x.example/jobs")
    apply_ = F.when(n == 2, F.concat(F.lit("https://y.example/apply-here/"), (F.col("s_suppkey") + 2000).cast("string"))).otherwise("https://y.example/")
    own = keys.identity_key(reference, F.col("s_name"), F.lit("source"), url, apply_, core)
    return table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("identity_key"), keys.semantic_key(core).alias("semantic_key"))


@oracle("""select s_suppkey, case s_suppkey % 4 when 0 then 'R-' || s_suppkey when 1 then 'ats-' || s_suppkey when 2 then 'C-12/' || s_suppkey else '' end as reference from supplier""")
@query
def external_references(spark, sf_dir):
    n, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    pages = F.when(n == 2, F.array(F.lit("Réf : 12"), F.concat(F.lit("see Référence du concours : C-12/"), key, F.lit("."))))
    found = keys.external_reference(F.when(n == 0, F.concat(F.lit(" R-"), key)).otherwise(" "), F.when(n == 1, F.concat(F.lit("ats-"), key)), pages=F.coalesce(pages, F.array().cast("array<string>")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("reference"))


@oracle("""select s_suppkey, case s_suppkey % 4 when 0 then 'url:https://x.example/job/' || s_suppkey when 1 then 'csod:r' || s_suppkey when 2 then 'source:r' || s_suppkey else 'url:https://x.example/job/' || s_suppkey end as id from supplier""")
@query
def discovery_ids(spark, sf_dir):
    n, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    provider = _pick(F.col("s_suppkey"), " Workday", "CSOD", "", "phenom")
    found = keys.discovery_id(provider, F.when(n < 3, F.concat(F.lit("R"), key)), F.concat(F.lit("https://X.example/job/"), key, F.lit("/#a")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("id"))


@oracle(f"select page_id, substr(sha1(canonical), 1, 16) as article_id from ({SQL['url_canonical']})")
@query
def article_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", keys.article_id(F.col("url")).alias("article_id"))


@oracle("select p_partkey, p_partkey % 3 = 1 as \"foreign\" from part")
@query
def foreign_details(spark, sf_dir):
    own, other = F.lit("https://x.example/jobs/1000"), _pick(F.col("p_partkey"), "https://x.example/jobs/1000?ref=a", "http://www.x.example/jobs/1001", "https://y.example/jobs/1001")
    return table(spark, sf_dir, "part").select("p_partkey", keys.is_foreign_detail(own, other).alias("foreign"))


# Classifiers

_ERRORS = ("HTTP 403 Forbidden", "429 Too Many Requests", "503 Service Unavailable", "Read timed out", "returned empty response", "provider cooling down", "Missing key", "odd")


@oracle(f"select event_id, {_sql('event_id', 'auth', 'quota', 'outage', 'timeout', 'empty', 'cooldown', 'config', 'provider_error')} as category from events")
@query
def error_categories(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", classify.error_category(_pick(F.col("event_id"), *_ERRORS)).alias("category"))


_TITLES = ("Résultats définitifs du concours", "Liste des convoqués à l'oral", "Résultats", "Concours de recrutement", "Offre d'emploi", "Agent")
_BODIES = ("x", "x", "liste provisoire", "les final results will follow", "poste", "concours ouvert")


@oracle(f"""select p_partkey, {_sql('p_partkey', 'final_results', 'candidate_list', 'results', 'competition', 'vacancy', 'competition')} as kind,
    {_sql('p_partkey', '', '', 'provisional', 'final', '', '')} as status from part""")
@query
def notice_types(spark, sf_dir):
    """Types and statuses of notices; the title outranks the body."""
    title, body = _pick(F.col("p_partkey"), *_TITLES), _pick(F.col("p_partkey"), *_BODIES)
    return table(spark, sf_dir, "part").select("p_partkey", classify.notice_type(title, body).alias("kind"), classify.notice_status(title, body).alias("status"))


@oracle(f"select p_partkey, {_cases('p_partkey', '4', '3', '2', '0', '4')}::int as focus from part")
@query
def focus_priorities(spark, sf_dir):
    text = _pick(F.col("p_partkey"), "SOC analyst", "Data engineer", "Stage en vente", "Driver", "Software developer")
    return table(spark, sf_dir, "part").select("p_partkey", classify.focus_priority(text, F.col("p_partkey") % 5 == 4).alias("focus"))


@oracle(f"""select p_partkey, {_sql('p_partkey', 'FULL_TIME', 'INTERN', 'TEMPORARY', 'CONTRACTOR', '', 'PER_DIEM')} as employment, {_sql('p_partkey', 'MAD', 'EUR', 'USD', 'GBP', '')} as currency from part""")
@query
def employment_and_currency(spark, sf_dir):
    work, pay = _pick(F.col("p_partkey"), "CDI temps plein", "Stage PFE", "cdd", "contractor", "x", "Per-Diem"), _pick(F.col("p_partkey"), "10 DH", "5 €", "7 $", "3 pound", "9")
    return table(spark, sf_dir, "part").select("p_partkey", classify.employment_type(work).alias("employment"), classify.currency(pay, F.lit(None).cast("string")).alias("currency"))


@oracle(f"select p_partkey, {_sql('p_partkey', 'Rabat', 'El Jadida', '', 'Fès')} as city from part")
@query
def cities_in_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", classify.city(_pick(F.col("p_partkey"), "Poste à RABAT-centre", "el jadida, Maroc", "Rabatteur", "à Fès.")).alias("city"))


@oracle(f"""select p_partkey, {_sql('p_partkey', 'mail', 'document', 'document', 'apply', 'other')} as kind, {_cases('p_partkey', 'false', 'false', 'false', 'true', 'false')} as misfiled from part""")
@query
def link_kinds(spark, sf_dir):
    label = _pick(F.col("p_partkey"), "Mail", "Notice", "Télécharger le communiqué", "Postuler", "Home")
    href = _pick(F.col("p_partkey"), "mailto:a@b.example", "https://x.example/a.PDF?x=1", "https://x.example/c", "https://x.example/d", "https://x.example/")
    return table(spark, sf_dir, "part").select("p_partkey", classify.link_kind(label, href).alias("kind"), classify.is_misfiled_document(label, F.lit(""), href).alias("misfiled"))


@oracle("""select p_partkey, case when p_size % 3 = 0 then 1.0 when p_size % 3 = 1 then 0.5 else 0.0 end::double as similarity from part""")
@query
def name_similarities(spark, sf_dir):
    a = _pick(F.col("p_size"), "ACME  Corp.", "Acme Maroc", "Zeta")
    b = _pick(F.col("p_size"), "Careers at Acme Corp (MA)", "acme group", "Omega Labs")
    return table(spark, sf_dir, "part").select("p_partkey", classify.name_similarity(a, b).cast("double").alias("similarity"))


@oracle("select event_type, substr(sha256('newjob' || event_type), 1, 20) as fingerprint, count(*) n from events group by all")
@query
def caption_prints(spark, sf_dir):
    """Captions that differ in address, tags, case and marks alone."""
    caption = F.concat(F.lit("‏New  JOB: "), F.upper("event_type"), F.lit(" https://x.example/"), F.col("event_id"), F.lit(" #tag_"), F.col("user_id"))
    return table(spark, sf_dir, "events").groupBy("event_type", classify.caption_fingerprint(caption).alias("fingerprint")).agg(F.count("*").alias("n"))


# Local time


@oracle("select strftime(ts + interval 1 hour, '%Y-%m-%d') as day, isodow(ts + interval 1 hour)::int - 1 as weekday, count(*) n from events group by all")
@query
def local_days(spark, sf_dir):
    """Events by day and weekday of the readers' zone, an hour ahead of UTC in January."""
    here = local.local(F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(local.day_key(F.col("ts")).alias("day"), F.weekday(here).alias("weekday")).agg(F.count("*").alias("n"))


@oracle("""select event_id, case event_id % 4 when 0 then epoch_us(ts::date + interval 1 day) - 1 - 3600000000 when 1 then epoch_us(date_trunc('second', ts)) when 2 then epoch_us(ts::date) end::bigint as deadline_us from events""")
@query
def deadline_times(spark, sf_dir):
    """Deadlines: a day ends at its local midnight, a time is itself; placeholders and junk are none."""
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "dd/MM/yyyy")).otherwise("2099-01-01")
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(local.deadline_time(text, _now())).alias("deadline_us"))


@oracle("""select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d') else '' end as posted from events""")
@query
def posted_dates(spark, sf_dir):
    n, ts = F.col("event_id") % 4, F.col("ts")
    published = F.when(n == 0, F.date_format(ts, "yyyy-MM-dd")).when(n == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", local.date_posted(published, n == 2, F.date_format(ts, "yyyy-MM-dd HH:mm")).alias("posted"))


@oracle("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as claims from orders")
@query
def deadline_claims(spark, sf_dir):
    """The date after a cue in its sentence; dates elsewhere are no claims."""
    text = F.concat(F.lit("Published 01/02/1999. Date limite : "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" at noon! Exam 2003-04-05\nDeadline soon"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(local.deadline_claims(text), " ").alias("claims"))


@oracle("select event_id, epoch_us(case event_id % 3 when 0 then ts::date::timestamp when 1 then timestamp '2023-05-06 07:08:09' else timestamp '2022-01-02' end) as published_us from events")
@query
def published_times(spark, sf_dir):
    n = F.col("event_id") % 3
    found = local.published_time(F.when(n == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(" "), F.when(n == 1, F.lit("2023-05-06T07:08:09Z")), F.lit("2022-01-02"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(found).alias("published_us"))


@oracle("""select event_id, case event_id % 5 when 0 then epoch_us(date_trunc('second', ts)) when 1 then epoch_us(date_trunc('second', ts)) when 4 then null else epoch_us(ts::date) end::bigint as us from events""")
@query
def parsed_times(spark, sf_dir):
    """Times with and without a zone, days in two forms, junk."""
    n, ts = F.col("event_id") % 5, F.col("ts")
    forms = {0: "yyyy-MM-dd'T'HH:mm:ss'Z'", 1: "yyyy-MM-dd HH:mm:ss", 2: "dd/MM/yyyy", 3: "dd-MM-yyyy"}
    text = F.lit("soon")
    for i, form in forms.items():
        text = F.when(n == i, F.date_format(ts, form)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(times.parse(text)).alias("us"))


@oracle("select o_orderkey, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as deadline, o_orderdate::date > date '1995-06-01' + 1830 as placeholder from orders")
@query
def labelled_deadlines(spark, sf_dir):
    """The date after a deadline's label, in two forms; and which are so far off that they stand for none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("open 2001-01-01, deadline: "), day)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Dernier délai le "), F.date_format("o_orderdate", "d/M/yyyy"))).otherwise(day)
    far = times.is_placeholder_deadline(F.col("o_orderdate"), F.lit("1995-06-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.deadline(text).alias("deadline"), far.alias("placeholder"))


# Pacing and state


@oracle("""with e as (select event_id, ts + interval 1 hour l, user_id % 10 as n, ts + interval 1 hour - (user_id % 7) * interval 20 minute as last from events where event_type = 'signup'),
    r as (select *, n >= 8 as a, hour(l) < 8 or hour(l) >= 21 as b, last + interval 70 minute > l as c from e)
    select event_id, concat_ws(',', case when a then 'daily_cap' end, case when b then 'inactive_hours' end, case when c then 'spacing' end) as reasons, not (a or b or c) as allowed_now,
      epoch_us(greatest(l, case when a then l::date + interval 32 hour else l end, case when b then case when hour(l) >= 21 then l::date + interval 32 hour else l::date + interval 8 hour end else l end,
        case when c then last + interval 70 minute else l end)) as next_us from r""")
@query
def publish_windows(spark, sf_dir):
    """Whether a publication is allowed at each event's time, why not, and when next, on the readers' clock."""
    events = table(spark, sf_dir, "events").filter("event_type = 'signup'").withColumn("at", F.col("ts").cast("timestamp"))
    last = F.timestamp_micros(F.unix_micros("at") - F.col("user_id") % 7 * 1_200_000_000)
    status = schedule.window_status(F.col("at"), F.col("user_id") % 10, F.lit(8), last, 8, 21, 70)
    return events.select("event_id", F.array_join(status["reasons"], ",").alias("reasons"), status["allowed_now"].alias("allowed_now"), F.unix_micros(status["next_allowed"]).alias("next_us"))


@oracle("""with s as (select unnest([600, 1080, 2040, 3480, 4980, 6420, 8280]) m), e as (select event_id, ts, date_trunc('week', ts) w, floor(epoch_us(ts) / 60000000 - epoch_us(date_trunc('week', ts)) / 60000000) m from events where event_type = 'click')
    select event_id, (select max(m) from s where s.m <= e.m and e.m < s.m + 50)::bigint as slot, (epoch_us(w) // 1000000 + 60 * coalesce((select min(m) from s where s.m > e.m), 600 + 10080))::bigint as next_start from e""")
@query
def slot_search(spark, sf_dir):
    """The weekly slot that each click falls in, and the next one's start, over the end of the week too."""
    slots = spark.createDataFrame([(m // 1440, m % 1440) for m in (600, 1080, 2040, 3480, 4980, 6420, 8280)], "weekday int, minute int")
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'").withColumn("at", F.col("ts").cast("timestamp"))
    return schedule.next_slot(clicks, slots, "event_id", "at")


_STEP = "case split_part(acc, ':', 1) || '>' || x " + " ".join(f"when '{s}>{e}' then '{t}:' || (split_part(acc, ':', 2)::int + 1)" for s, e, t in schedule.STEPS) + " else acc end"


@oracle(f"""with e as (select user_id, list(case event_type when 'view' then 'scored' when 'click' then 'select' when 'purchase' then 'publish' when 'error' then 'fail' else 'repair' end order by ts, event_id) es from events group by 1),
    f as (select user_id, list_reduce(list_prepend('new:0', es), lambda acc, x: {_STEP}) as fin from e) select user_id, split_part(fin, ':', 1) as status, split_part(fin, ':', 2)::int as applied from f""")
@query
def status_machine(spark, sf_dir):
    """Each user's status after its events, as steps of an article's life."""
    step = F.element_at(F.create_map(*map(F.lit, ("view", "scored", "click", "select", "purchase", "publish", "error", "fail", "signup", "repair"))), F.col("event_type"))
    return schedule.run_machine(table(spark, sf_dir, "events").withColumn("step", step), ["user_id"], "step", ["ts", "event_id"])


@oracle("""select event_id, case when event_type = 'error' then 'old' when event_id % 3 = 0 then 'head' else 'resumed' end as cursor, event_type = 'error' or event_id % 3 = 0 as deferred from events""")
@query
def backlog_cursors(spark, sf_dir):
    found = schedule.cursor_after(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, F.lit("head")), F.lit("old"), F.lit("resumed"))
    return table(spark, sf_dir, "events").select("event_id", found["cursor"].alias("cursor"), found["deferred"].alias("deferred"))


@oracle("""with l as (select c_custkey k, max(o_orderdate) last from customer left join orders on c_custkey = o_custkey group by 1) select k, epoch_us(coalesce(last - interval 10 minute, timestamp '2001-08-31 18:00:00')) as from_us from l""")
@query
def crawl_windows(spark, sf_dir):
    """Where the next read of each customer starts: shortly before the last, or six hours ago."""
    last = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.expr("c_custkey = o_custkey"), "left").groupBy(F.col("c_custkey").alias("k")).agg(F.max("o_orderdate").cast("timestamp").alias("last"))
    return last.select("k", F.unix_micros(schedule.crawl_from(F.col("last"), F.lit("2001-09-01").cast("timestamp"))).alias("from_us"))


@oracle("""with o as (select o_custkey, o_orderpriority, min(o_orderdate) p, o_orderkey % 2 as old from orders where year(o_orderdate) = 2000 group by all),
    f as (select * from o qualify row_number() over (partition by o_custkey, o_orderpriority order by old, p) = 1)
    select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by old, p, o_orderpriority)::int as place from f qualify place <= 2""")
@query
def yearly_memory(spark, sf_dir):
    """Each customer's two newest priorities of the year, the even orders' batch before the odd ones' memory."""
    of = lambda odd: table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("p")).drop("y")
    return schedule.yearly_memory(of(1), of(0), "o_custkey", "o_orderpriority", "p", F.lit("2000-05-05").cast("timestamp"), 2)


@oracle("""select event_id, case when event_type <> 'view' then 'posted' when event_id % 5 >= 3 and value >= 20 then 'pending' else 'uncertain' end as status from events""")
@query
def reopened_deliveries(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "uncertain").otherwise("posted")
    return table(spark, sf_dir, "events").select("event_id", schedule.reopened(status, F.col("event_id") % 5, F.col("value")).alias("status"))


@oracle("""select case when o_orderstatus = 'O' and o_orderkey % 3 = 0 and d > 60 then 'archive_undated' when o_orderstatus = 'P' and d > 7 then 'archive_old' else 'keep' end as action, count(*) n
    from (select *, (epoch_us(timestamp '2001-08-20') - epoch_us(o_orderdate)) / 86400000000.0 d from orders) group by 1""")
@query
def stale_rows(spark, sf_dir):
    status = F.element_at(F.create_map(*map(F.lit, ("O", "ready", "P", "failed", "F", "published"))), F.col("o_orderstatus"))
    action = schedule.stale_action(status, F.when(F.col("o_orderkey") % 3 > 0, F.lit("2001-12-01")), [F.lit(None).cast("timestamp_ntz"), F.col("o_orderdate")], F.lit("2001-08-20").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@oracle("""select event_id, row_number() over (partition by user_id, (ts + interval 1 hour)::date order by ts, event_id)::int as nth, nth <= 2 as under_cap from events""")
@query
def local_day_caps(spark, sf_dir):
    """Each event's place in its user's local day, and whether it is under a cap of two."""
    return schedule.rate_limited(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 2).select("event_id", "nth", "under_cap")


@oracle("""select event_type, count(*) filter (where h >= 0 and h <= 240) as in_time, count(*) filter (where not (h >= 0 and h <= 240)) as late from (select *, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0 h from events) group by 1""")
@query
def stale_split(spark, sf_dir):
    """Events in time, and those dropped as known to be stale."""
    kept, late = jobs.split_late(table(spark, sf_dir, "events"), "ts", 240, _now())
    both = kept.select("event_type", F.lit(1).alias("k")).union(late.select("event_type", F.lit(0)))
    return both.groupBy("event_type").agg(F.count_if(F.col("k") == 1).alias("in_time"), F.count_if(F.col("k") == 0).alias("late"))


@oracle("""with p as (select user_id, max(ts) + interval 6 hour as until from events where event_type = 'error' group by 1) select bool_and(until > timestamp '2024-01-20') as open, case when open then epoch_us(min(until)) end as until_us from p""")
@query
def global_circuit(spark, sf_dir):
    """The global circuit: open while every provider's is."""
    providers = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg((F.max("ts").cast("timestamp") + F.expr("interval 6 hours")).alias("until"))
    return jobs.global_circuit(providers, F.lit("2024-01-20").cast("timestamp")).select("open", F.unix_micros("until").alias("until_us"))


@oracle("select user_id, case when user_id % 3 > 0 then max(event_id) end as cursor, count(*) n from events group by 1")
@query
def cursor_reset(spark, sf_dir):
    """Cursors of the users whose queue was lost set back."""
    state = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.count("*").alias("n"))
    return jobs.reset(state, F.col("user_id") % 3 == 0, ["cursor"])


@oracle("""select o_orderkey, case when p >= 14 then 12 when p >= 10 then 12 when p >= 7 then 11 when p >= 4 then 10 when p >= 2 then 9 else 8 end::int as cap from (select o_orderkey, o_custkey % 17 as p from orders)""")
@query
def stage_caps(spark, sf_dir):
    """The daily cap of a health score."""
    return table(spark, sf_dir, "orders").select("o_orderkey", ladders.step(F.col("o_custkey") % 17, (0, 2, 4, 7, 10, 14), (8, 9, 10, 11, 12, 12)).alias("cap"))


# Reports


def _queue(spark, sf_dir):
    """Orders as queue rows."""
    status = F.element_at(F.create_map(*map(F.lit, ("O", "ready", "P", "skipped", "F", "published"))), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), status.alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("old")).when(F.col("o_orderkey") % 5 < 3, F.lit("no_channel")).alias("skip_reason"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("retry_at"), (F.col("o_orderkey") % 2 == 0).alias("fetched"), (F.col("o_orderkey") % 7 == 0).alias("hold"),
        F.when(F.col("o_totalprice") < 90_000, F.lit("short_text")).when(F.col("o_totalprice") < 200_000, F.lit("no_date")).alias("quality_reason"),
    )


@oracle("""with q as (select *, o_orderstatus = 'O' as ready, case when o_totalprice < 90000 then 'short_text' when o_totalprice < 200000 then 'no_date' end as r from orders),
    t as (select arg_min(r, (-n, r)) as r from (select r, count(*) n from q where ready and r is not null group by 1))
    select 'quality' as reason, (select count(*) from q where ready) as n, r as top, null::timestamp as earliest_retry from t""")
@query
def blocker_report(spark, sf_dir):
    """Why nothing of a queue of orders was selected."""
    return reports.blocker(_queue(spark, sf_dir), F.lit("1995-02-01").cast("timestamp")).withColumn("earliest_retry", F.col("earliest_retry").cast("timestamp_ntz"))


@oracle("""select count(*) filter (where ts::date = date '2024-01-15' and event_type = 'signup') as drafts, count(*) filter (where ts::date = date '2024-01-15' and event_type = 'purchase') as lives,
    epoch_us(max(ts)) as last_us, epoch_us(max(ts) + interval 70 minute) as next_us, max(ts) + interval 70 minute <= timestamp '2024-01-15 20:00:00' as allowed from events where event_type in ('signup', 'purchase')""")
@query
def schedule_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type in ('signup', 'purchase')").withColumn("kind", F.when(F.col("event_type") == "signup", "draft").otherwise("live"))
    got = reports.schedule(rows, "ts", "kind", F.lit("2024-01-15 20:00:00").cast("timestamp"), 70)
    return got.select("drafts", "lives", F.unix_micros("last").alias("last_us"), F.unix_micros("next_allowed").alias("next_us"), "allowed")


@oracle("""select l_orderkey, count(*) filter (where l_quantity > 40) as high, count(*) filter (where l_quantity > 20 and l_quantity <= 40) as medium, count(*) filter (where l_quantity <= 20) as low,
    case when high > 0 then 'high' when medium > 0 then 'medium' else 'low' end as confidence from lineitem group by 1""")
@query
def confidence_summary(spark, sf_dir):
    level = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    return reports.confidence_summary(table(spark, sf_dir, "lineitem").withColumn("confidence", level), "l_orderkey")


_AUDIT = (
    "<h1>T</h1><p>a b</p>", "<h2>One</h2><h3> one</h3><a href='javascript:x'>x</a><img src=a>", "<h2>Part of it</h2><img src='a' alt='b'>" + "<p>word and more</p>" * 100, "<p>one two three four</p>" * 130,
)


@oracle(f"""select page_id, {_sql('page_id', 'short_text,inline_h1', 'duplicate_headings,invalid_link,tiny_heading,image_without_alt,short_text', '', 'long_without_h2,long_without_internal_link')} as issues,
    {_cases('page_id', '10', '50', '0', '8')}::int as weight from pages""")
@query
def content_audit(spark, sf_dir):
    """What is wrong with published pages, of four kinds of markup."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("A title").alias("title"), _pick(F.col("page_id"), *_AUDIT).alias("page"))
    text = texts.clean(F.regexp_replace("page", "<[^>]+>", " "))
    return reports.audit(pages, "page", "title", text, "x.example").select("page_id", F.array_join("issues", ",").alias("issues"), "weight")


@oracle("""select issue, count(*) n from (select unnest(string_split(issues, ',')) as issue from (%s) where issues <> '') group by 1 order by n desc, issue limit 10""" % SQL["content_audit"])
@query
def audit_histogram(spark, sf_dir):
    return tables.histogram(content_audit(spark, sf_dir).filter("issues <> ''"), F.split("issues", ","), 10).withColumnRenamed("label", "issue")


@oracle("""select count(*) as runs, count(*) filter (where ok) as succeeded, count(*) filter (where not ok) as failed, coalesce(sum(user_id), 0)::bigint as found, epoch_us(max(ts) filter (where ok)) as last_ok_us
    from (select *, event_type <> 'error' as ok from events) where ts > timestamp '2024-01-19' and ts <= timestamp '2024-01-20'""")
@query
def run_rollup(spark, sf_dir):
    """Runs of a day, as events."""
    runs = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return reports.roll_up(runs, "ts", "ok", "user_id", F.lit("2024-01-20").cast("timestamp")).select("runs", "succeeded", "failed", "found", times.micros(F.col("last_ok")).alias("last_ok_us"))


@oracle("select user_id, floor((epoch_us(timestamp '2024-01-31') - epoch_us(min(ts))) / 60000000)::bigint as oldest_minutes from events where event_type = 'signup' group by 1")
@query
def oldest_pending(spark, sf_dir):
    return reports.oldest(table(spark, sf_dir, "events").filter("event_type = 'signup'"), ["user_id"], "ts", _now())


@oracle("""with r as (select * from orders order by o_orderdate desc, o_orderkey desc limit 200) select 'o_orderpriority' as style, o_orderpriority as value, count(*) n from r group by all
    union all select 'o_orderstatus', o_orderstatus, count(*) from r group by all""")
@query
def style_usage(spark, sf_dir):
    """How often each priority and status is used by the newest 200 orders."""
    return reports.usage(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 200, F.desc("o_orderdate"), F.desc("o_orderkey"))


@oracle("""select o_orderkey, (case when o_orderkey % 2 = 0 then 4 else 0 end + 1 + case when o_custkey % 3 > 0 then 1 else 0 end + 2 + case when o_orderkey % 5 = 0 then 3 else 0 end + 1)::int as strength,
    (1 + case when o_custkey % 3 > 0 then 1 else 0 end + 2 + case when o_orderkey % 5 = 0 then 3 else 0 end)::int as comparison_strength,
    concat_ws(',', case when o_orderkey % 2 = 0 then 'reference' end, 'deadline', case when o_custkey % 3 > 0 then 'positions' end, 'tables', case when o_orderkey % 5 = 0 then 'pdf_text' end, 'documents') as categories,
    substr(sha256('{"deadline":"' || strftime(o_orderdate, '%Y-%m-%d') || '","document_facts":' || case when o_orderkey % 5 = 0 then '["f"]' else '[]' end || ',"positions":' || (o_custkey % 3) || ',"table_facts":["a","b=' || o_orderpriority || '"]}'), 1, 24) as signature from orders""")
@query
def evidence_snapshots(spark, sf_dir):
    none = F.array().cast("array<string>")
    facts = F.array(F.concat(F.lit("b="), "o_orderpriority"), F.lit("a"))
    found = reports.evidence(
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("R1")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey") % 3, facts, F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("f"))).otherwise(none), F.array(F.lit("u"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", found["strength"].alias("strength"), found["comparison_strength"].alias("comparison_strength"), F.array_join(found["categories"], ",").alias("categories"), found["signature"].alias("signature"))


@oracle("""select user_id, event_id from events where ts::date in (select distinct ts::date from events order by 1 desc limit 7)""")
@query
def last_week(spark, sf_dir):
    """Events of the newest seven days that have any."""
    return reports.last_days(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", 7).select("user_id", "event_id")


# Policies


@oracle("""select o_orderkey, greatest(o_orderdate, case when o_orderkey % 2 = 0 then o_orderdate + interval 40 day end) > timestamp '1998-06-01' as failing, o_orderstatus <> 'P' and o_orderkey % 3 > 0 and o_orderdate <= timestamp '1998-06-01' as selectable from orders""")
@query
def retry_clocks(spark, sf_dir):
    """Rows whose latest retry clock is still to come, and rows that can be selected."""
    now, at = F.lit("1998-06-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    failing = gates.in_recent_failure([at, F.when(F.col("o_orderkey") % 2 == 0, at + F.expr("interval 40 days"))], now)
    open_ = gates.selectable(F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ready"), F.lit(None).cast("boolean"), F.col("o_orderkey") % 3 > 0, [at], now)
    return table(spark, sf_dir, "orders").select("o_orderkey", failing.alias("failing"), open_.alias("selectable"))


@oracle("""with q as (select o_orderkey, case when o_orderkey % 4 > 0 then o_orderdate end as due, o_orderkey % 8 = 0 and o_orderpriority <> '5-LOW' as rolling, o_custkey % 5 = 0 as above from orders)
    select o_orderkey, concat_ws(',', case when due is null and not rolling then 'no_deadline' end, case when due <= timestamp '1998-06-01' then 'deadline_passed' end, case when above then 'over_qualified' end) as reasons,
    coalesce(due <= timestamp '1998-06-01', false) or above as permanent_reject from q""")
@query
def publication_policy(spark, sf_dir):
    key = F.col("o_orderkey")
    rolling = gates.is_rolling(F.when(key % 8 == 0, "training").otherwise("job"), F.lit(True), F.col("o_orderpriority") != "5-LOW", F.lit("open all year"))
    degree = gates.qualification(F.array(F.when(F.col("o_custkey") % 5 == 0, F.lit("Master, bac+5")).otherwise("bac+2")), r"bac\+5", r"bac\+3", r"bac\+2")
    got = gates.publication_policy(F.when(key % 4 > 0, F.col("o_orderdate").cast("timestamp")), rolling, degree, F.lit("1998-06-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(got["reasons"], ",").alias("reasons"), got["permanent_reject"].alias("permanent_reject"))


@oracle("""select o_orderkey, o_orderstatus <> 'P' and o_orderdate >= timestamp '1998-06-01' as fresh, o_orderstatus = 'O' and o_custkey % 4 > 1 and o_totalprice > 50000 as publishable,
    o_orderstatus = 'F' and o_custkey % 4 <> 0 as social_pending, o_orderstatus <> 'O' and o_custkey % 4 = 2 and o_orderdate <= timestamp '1998-06-01' as social_candidate from orders""")
@query
def eligibility(spark, sf_dir):
    """Whether orders, as rows of several kinds, are fresh, can be published or posted, or are still to be delivered."""
    now, at, k = F.lit("1998-06-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp"), F.col("o_custkey") % 4
    fresh = gates.is_fresh_candidate(F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ready"), F.lit(False), at, now)
    provider = _pick(F.col("o_custkey"), "", "deterministic:x", "one", "Two")
    publishable = gates.is_publishable(F.when(F.col("o_orderstatus") == "O", "selected").otherwise("new"), F.lit("ready_for_ai"), F.lit("completed"), F.lit("passed"), provider, F.lit(None).cast("boolean"), F.when(F.col("o_totalprice") > 50_000, F.lit("<p>")))
    pending = gates.social_retry_pending(F.col("o_orderstatus") == "F", F.when(k == 0, "posted").otherwise("facebook_pending"), F.when(k == 0, F.lit("1")), F.when(k == 0, F.lit("2")))
    social = gates.is_social_candidate(F.col("o_orderstatus") != "O", F.lit(True), F.when(k == 1, F.lit("id")), k == 3, F.when(k == 0, "uncertain").otherwise("failed"), at, now)
    return table(spark, sf_dir, "orders").select("o_orderkey", fresh.alias("fresh"), publishable.alias("publishable"), pending.alias("social_pending"), social.alias("social_candidate"))


@oracle(r"""select doc_id, case when length(text) >= 1200 and w >= 180 then 'strong' when length(text) >= 300 and w >= 40 then 'weak' else 'failed' end as status, w >= 120 and length(text) >= 700 as enough
    from (select doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) w from documents)""")
@query
def enrichment_status(spark, sf_dir):
    words, chars = texts.word_count(F.col("text")), F.char_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", gates.enrichment_status(chars, words).alias("status"), gates.is_enriched_enough(words, chars, F.lit("success")).alias("enough"))


@oracle(f"""with l as (select p_brand, p_partkey, {_cases('p_partkey', "'https://docs.python.example/a/' || p_size", "'https://trusted.example/x'", "'https://x.example/own'", "'https://sub.trusted.example/y?aff=1'", "'https://other.example/'")} as url from part),
    k as (select p_brand, min(p_partkey) p, url from l where url like '%trusted.example%' and url not like '%aff=%' or url like '%python.example%' group by all)
    select p_brand, url from k qualify row_number() over (partition by p_brand order by p) <= 5""")
@query
def trusted_references(spark, sf_dir):
    """The first five trusted links of every brand, as a page."""
    n = F.col("p_partkey")
    link = F.when(n % 5 == 0, F.concat(F.lit("https://docs.python.example/a/"), F.col("p_size"), F.lit("?utm_source=z"))).otherwise(_pick(n, "", "https://trusted.example/x/", "https://x.example/own", "https://sub.trusted.example/y?aff=1", "https://other.example/"))
    links = table(spark, sf_dir, "part").select("p_brand", "p_partkey", link.alias("url"), F.lit("https://www.x.example/").alias("site"))
    return gates.trusted_references(links, "p_brand", "p_partkey", "url", "site", ("trusted.example", "python.example", "x.example")).select("p_brand", "url")


@oracle(f"select p_partkey, {_cases('p_partkey', 'true', 'false', 'true', 'false')} as noise, {_cases('p_partkey', 'false', 'true', 'false')} as affiliate from part")
@query
def noise_filters(spark, sf_dir):
    text, url = _pick(F.col("p_partkey"), "Accept all Cookies", "A plain line", "Subscribe now", None), _pick(F.col("p_partkey"), "https://x.example/", "https://x.example/?a=1&AffId=3", "https://x.example/tags/one")
    return table(spark, sf_dir, "part").select("p_partkey", gates.is_noise(text).alias("noise"), gates.is_affiliate(url).alias("affiliate"))


_STYLE = ("Concours de recrutement de dix ingénieurs", "Short", "Annonce officielle de la commune urbaine", "Recrutement chez www.x.example de dix agents", "Offre d'emploi: technicien sur emploi.ma à Rabat", "Recrutement de x")


@oracle(f"""select p_partkey, {_sql('p_partkey', '', 'too_short', 'type_not_named', 'has_address', 'has_domain', 'too_short')} as problem, {_cases('p_partkey', 'true', 'false', 'false')} as repeats from part""")
@query
def title_rules(spark, sf_dir):
    """The first style rule that a title breaks, and whether a heading says it again."""
    title = _pick(F.col("p_partkey"), *_STYLE)
    heading = _pick(F.col("p_partkey"), "Recrutement de ingénieurs: concours, dix postes", "Concours", "Annonce d'une réunion du conseil")
    repeats = gates.repeats_title(F.when(F.col("p_partkey") % 3 == 0, F.lit(_STYLE[0])).otherwise(title), heading)
    return table(spark, sf_dir, "part").select("p_partkey", gates.title_problem(title, F.when(F.col("p_partkey") % 6 == 0, "competition").otherwise("vacancy")).alias("problem"), repeats.alias("repeats"))


@oracle(f"""select p_partkey, {_sql('p_partkey', 'jobs,internships,jobs-morocco', 'jobs,remote-jobs', 'jobs,training,jobs-abroad,visa-sponsorship', 'jobs,jobs-morocco,visa-sponsorship')} as labels from part""")
@query
def posting_labels(spark, sf_dir):
    n = F.col("p_partkey")
    found = gates.labels(_pick(n, "internship", "job", "training", "job"), _pick(n, "ma", "FR", None, "FR"), _pick(n, None, "remote_morocco", "", "Morocco "), F.lit(None).cast("boolean"), n % 4 > 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("labels"))


@oracle("""select o_orderkey from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F' and c_mktsegment in ('BUILDING', 'MACHINERY')""")
@query
def retired_sources(spark, sf_dir):
    """Unpublished orders of retired segments, by name in any case."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    gone = spark.createDataFrame([(" Building",), ("machinery",), ("BUILDING",), ("",)], "c_mktsegment string")
    return gates.retired(rows, gone, "c_mktsegment", F.col("o_orderstatus") == "F").select("o_orderkey")


@oracle("""select p_partkey, p_size % 3 = 0 as repeated, case when p_size % 4 = 0 then 'hook_used_before' else '' end || case when p_size % 4 = 1 then 'too_many_lines' else '' end as problems from part""")
@query
def copy_checks(spark, sf_dir):
    """Repeated rows of a table, and what is wrong with a short text."""
    rows = F.array(F.array(F.lit("A"), F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a."), F.upper("p_name"))).otherwise(F.array(F.lit("b"))))
    text = F.when(F.col("p_size") % 4 == 0, F.lit("Old  hook\nmore")).when(F.col("p_size") % 4 == 1, F.lit("x\n" * 13 + "y")).otherwise("Fine\ntext")
    return table(spark, sf_dir, "part").select("p_partkey", gates.has_repeated_rows(rows).alias("repeated"), F.array_join(gates.copy_problems(text, F.array(F.lit("old hook"))), ",").alias("problems"))


# Rankings


@oracle("""select o_orderkey, row_number() over (order by case when o_orderkey % 4 > 0 then o_orderdate end nulls first, case when o_orderkey % 3 > 0 then o_orderdate end nulls last, 'u' || lpad(o_orderkey::varchar, 9, '0'))::int as place from orders qualify place <= 50""")
@query
def fresh_queue_order(spark, sf_dir):
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    order = gates.fresh_order(F.when(key % 4 > 0, at), F.when(key % 3 > 0, at), F.concat(F.lit("u"), F.lpad(key.cast("string"), 9, "0")))
    return tables.top_k(table(spark, sf_dir, "orders").withColumn("one", F.lit(1)), ["one"], 50, *order, rank="place").select("o_orderkey", "place")


@oracle("""with s as (select s_suppkey, s_nationkey, max(l_shipdate)::date last from supplier left join (select * from lineitem where l_suppkey % 3 > 0) on s_suppkey = l_suppkey group by all)
    select s_suppkey, row_number() over (order by last nulls first, case s_nationkey % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end, s_suppkey::varchar)::int as place from s""")
@query
def source_order(spark, sf_dir):
    """Suppliers as sources: least recently read first, then by the hints of their names."""
    lines = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 > 0").groupBy(F.col("l_suppkey").alias("_s")).agg(F.to_date(F.max("l_shipdate")).alias("last"))
    name = _pick(F.col("s_nationkey"), "The Ministry", "Big University", "AI tools", "Other")
    rows = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("_s"), "left").withColumn("one", F.lit(1))
    order = gates.source_order(F.col("last"), name, F.col("s_suppkey").cast("string"), ("ministry", "university"))
    return tables.top_k(rows, ["one"], 1_000_000, *order, rank="place").select("s_suppkey", "place")


@oracle("""select s_suppkey, count(*) n from lineitem join supplier on s_suppkey = l_suppkey where l_returnflag = 'R' group by 1 order by n desc, s_suppkey limit 20""")
@query
def source_issues(spark, sf_dir):
    """The suppliers with most returned lines."""
    issues = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return issues.orderBy(F.desc("n"), "s_suppkey").limit(20)


@oracle("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 1 else 0 end desc, o_orderkey)::int as place from orders qualify place <= 3""")
@query
def document_picks(spark, sf_dir):
    """Three documents of each customer, by priority, then in order."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    return tables.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], 3, rank.desc(), "o_orderkey", rank="place").select("o_custkey", "o_orderkey", "place")


@oracle("""select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size desc, length(p_name), p_partkey)::int as place from part where p_size >= 20 qualify place <= 6""")
@query
def logo_picks(spark, sf_dir):
    """Six candidates of every brand that are good enough: best score, then shortest address."""
    return tables.top_k(table(spark, sf_dir, "part").filter("p_size >= 20"), ["p_brand"], 6, F.desc("p_size"), F.char_length("p_name"), "p_partkey", rank="place").select("p_brand", "p_partkey", "place")


@oracle("""select source, arg_max(doc_id, (n, -doc_id)) as doc_id, max(n)::int as chars from (select source, doc_id, coalesce(length(text), 0) n from documents) group by 1""")
@query
def longest_text(spark, sf_dir):
    """The longest text of each source, the first of equal ones."""
    docs = table(spark, sf_dir, "documents").withColumn("chars", F.coalesce(F.char_length("text"), F.lit(0)))
    return tables.top_k(docs, ["source"], 1, F.desc("chars"), "doc_id").select("source", "doc_id", "chars")


# Texts and hashes


@oracle(r"""select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9_]+', ' ', 'g')) as normalised, 'اجل ' || lower(p_brand) as folded, 'The first one. Second!' as trimmed,
    sha256('{"a":"' || p_brand || '","b":' || p_size || '}') as signature from part""")
@query
def text_forms(spark, sf_dir):
    """Normalised and folded texts, a text trimmed to its sentences, and the signature of canonical fields."""
    signature = jsons.signature({"b": F.col("p_size"), "a": F.col("p_brand"), "c": F.lit(None).cast("string")})
    return table(spark, sf_dir, "part").select(
        "p_partkey", texts.normalised(F.concat_ws(" ", "p_name", "p_brand")).alias("normalised"), texts.folded(F.concat(F.lit("أَجل  "), F.col("p_brand"))).alias("folded"),
        texts.trim_to_sentence(F.lit("The first one. Second! And a third that is cut"), 30).alias("trimmed"), signature.alias("signature"),
    )


# Joins


@oracle(f"""with k as (select page_id, {_HOST} || {_PATH} as u, 't' || (page_id % 40) as t from pages), f as (select u, min(page_id) fu from k group by 1), g as (select t, min(page_id) ft from k group by 1)
    select page_id, case when fu < page_id then 'url' else 'title' end as reason, case when fu < page_id then fu else ft end as earlier from k join f using (u) join g using (t) where fu < page_id or ft < page_id""")
@query
def duplicate_reasons(spark, sf_dir):
    """The first reason for which a page repeats an earlier one: its address, else one of forty titles."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.link_key(F.col("url")).alias("u"), F.concat(F.lit("t"), F.col("page_id") % 40).alias("t"))
    return tables.duplicate_reasons(rows, "page_id", [("url", "u"), ("title", "t")])


@oracle("""with b as (select p_brand, p_partkey % 2 as even, max(p_size) best from part group by all), s as (select p_brand, best, 1 as new_ from b where even = 0 and best >= 30 union all select p_brand, best, 0 from b where even = 1)
    select p_brand, best as p_size, new_ = 1 as fresh from s qualify row_number() over (partition by p_brand order by best desc, new_) = 1""")
@query
def registry_upsert(spark, sf_dir):
    """A registry with the findings that are sure enough in place of less sure entries."""
    from ..sources import sinks

    of = lambda even: table(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == (0 if even else 1)).groupBy("p_brand").agg(F.max("p_size").alias("p_size")).withColumn("fresh", F.lit(even))
    return sinks.registry_store(of(False), of(True), "p_brand", "p_size", 30)
