"""Queries of the gates, lookups and maintenance operators, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, texts, urls
from ..operators import gates, tables
from .catalogue import _now, query, table
from .oracle import SQL


def oracle(sql: str):
    def mark(f):
        SQL[f.__name__] = sql
        return f

    return mark


@oracle("""select o_orderkey from (select *, bool_or(o_orderpriority = '1-URGENT') over (partition by o_custkey) any_ from orders) where o_orderpriority = '1-URGENT' or not any_""")
@query
def prefer_subset(spark, sf_dir):
    """Each customer's urgent orders, or all where there are none."""
    return gates.prefer(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", ["o_custkey"]).select("o_orderkey")


@oracle("""select user_id, last <= timestamp '2024-01-31' - interval 12 hour as healthy from (select user_id, max(ts) last from events where event_type = 'error' group by 1)""")
@query
def cooldown_filter(spark, sf_dir):
    """Sources whose last failure is less than twelve hours old are cooling down."""
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg((F.max("ts").cast("timestamp") + F.expr("interval 12 hours")).alias("until"))
    healthy, waiting = gates.cooldown_split(failed, "until", _now())
    return healthy.select("user_id", F.lit(True).alias("healthy")).union(waiting.select("user_id", F.lit(False)))


@oracle("""with r as (select s_suppkey, s_nationkey, 'Customer#' || lpad((s_suppkey * 3)::varchar, 9, '0') n from supplier),
    m as (select s_suppkey, 0 k, c_custkey from r join customer on c_name = n union all select s_suppkey, 1, c_custkey from r join customer on c_nationkey = s_nationkey)
    select s_suppkey, c_custkey from m qualify row_number() over (partition by s_suppkey order by k, c_custkey) = 1""")
@query
def any_key_lookup(spark, sf_dir):
    """A customer for each supplier: of its derived name, else of its nation."""
    supplier = table(spark, sf_dir, "supplier").withColumn("n", F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")))
    return gates.any_key_lookup(supplier, table(spark, sf_dir, "customer"), "s_suppkey", [("n", "c_name"), ("s_nationkey", "c_nationkey")], "c_custkey")


@oracle(r"""with s as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) w, list_distinct(regexp_extract_all(text, '[0-9][0-9./:-]*[0-9]')) a, regexp_matches(lower(text), 'license|licence') k from conversations where text is not null),
    p as (select a.conv_id, a.turn as "left", b.turn as "right", len(list_intersect(a.w, b.w)) x, len(a.w) n, len(b.w) m, len(list_intersect(a.a, b.a)) > 0 as atom, a.k and b.k as kind
      from s a join s b on a.conv_id = b.conv_id and a.turn < b.turn and a.role <> b.role where len(a.w) >= 4 and len(b.w) >= 4)
    select conv_id, "left", "right", x::bigint as shared from p where (x >= 4 and x / least(n, m) >= 0.84 and x / (n + m - x) >= 0.55) or (x > 0 and atom and x / least(n, m) >= 0.65) or (kind and x >= 3 and x / least(n, m) >= 0.55)""")
@query
def block_repetition(spark, sf_dir):
    """Turns of a conversation that repeat the other role's, in their words, or in part with a number or a licence."""
    return gates.repeated_blocks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", categories={"licence": "license|licence"})


@oracle("""select o_orderkey, case when o_totalprice < 50000 then 'no_channel' when o_orderkey % 11 = 0 then 'bad_address' when o_orderkey % 7 = 0 then 'front_page'
    when o_custkey % 3 = 0 and o_orderstatus <> 'F' then 'foreign_channel' else '' end as reason from orders""")
@query
def application_gate(spark, sf_dir):
    """Refusals of application channels made from orders."""
    host = F.when(F.col("o_custkey") % 3 == 0, "other.example").otherwise("jobs.example")
    full = F.when(F.col("o_orderkey") % 11 == 0, F.lit("apply here")).when(F.col("o_orderkey") % 7 == 0, F.lit("https://www.jobs.example/")).otherwise(F.concat(F.lit("https://"), host, F.lit("/job/1")))
    url = F.when(F.col("o_totalprice") >= 50_000, full).otherwise(F.lit(" "))
    reason = gates.application_policy(url, F.lit(None).cast("string"), F.lit("https://jobs.example/x"), F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@oracle(r"""with t as (select doc_id, split_part(text, chr(10), 1) title, text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) words from documents),
    b as (select distinct doc_id from (select doc_id, substr(regexp_replace(lower(c), '[^\p{L}\p{N}_]+', '', 'g'), 1, 180) f from (
      select doc_id, trim(unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.!?]\s+', chr(10), 'g'), chr(10)))) c from documents)
      where length(c) >= 80) group by doc_id, f having count(*) > 1)
    select t.doc_id, reason = '' as passed, reason from (select t.doc_id, case when trim(title) = '' then 'no_title' when length(title) > 120 then 'long_title' when words < 40 then 'short_text'
      when regexp_matches(text, '(?m)^\s*[{\[]\s*"|"\s*:\s*["{\[]|^\s*#{1,6}\s|\*\*[^*\n]+\*\*|```') then 'visible_markup' when b.doc_id is not null then 'repeated_blocks' else '' end as reason from t left join b on t.doc_id = b.doc_id) t""")
@query
def quality_reasons(spark, sf_dir):
    gate = gates.quality_gate(texts.first_line(F.col("text")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", gate["passed"].alias("passed"), gate["reason"].alias("reason"))


@oracle("""with n as (select user_id, event_type, min(event_id) p from events where event_id % 4 = 0 group by all), o as (select user_id, event_type, min(event_id) p from events where event_id % 4 <> 0 group by all),
    u as (select *, 0 old from n union all select *, 1 from o), f as (select * from u qualify row_number() over (partition by user_id, event_type order by old, p) = 1)
    select user_id, event_type, row_number() over (partition by user_id order by old, p, event_type)::int as place from f qualify row_number() over (partition by user_id order by old, p, event_type) <= 3""")
@query
def recency_memory(spark, sf_dir):
    """Each user's three newest kinds of event, new batch before old memory."""
    of = lambda condition: table(spark, sf_dir, "events").filter(condition).groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    return gates.recency(of("event_id % 4 <> 0"), of("event_id % 4 = 0"), "user_id", "event_type", "p", 3)


@oracle("""select event_id, (case when row_number() over (partition by user_id order by ts, event_id) % 2 = 1 then 'new' else 'apply' end) as label from events where event_type = 'purchase'""")
@query
def template_rotation(spark, sf_dir):
    return gates.rotation(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), ["user_id"], ("new", "apply"), "ts", "event_id").select("event_id", "label")


@oracle("""select event_id, minutes_since, coalesce(minutes_since >= 70, true) as allowed from (select event_id,
    floor((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 60000000)::bigint as minutes_since from events where event_type = 'purchase')""")
@query
def post_spacing(spark, sf_dir):
    return gates.spacing(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), ["user_id"], "ts", 70, "event_id").select("event_id", "minutes_since", "allowed")


@oracle("""with e as (select *, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0 h, case event_type when 'error' then 'failed' when 'view' then 'selected' else 'ready' end st,
    case when user_id % 2 = 0 then 24 else 168 end lim from events)
    select case when st = 'failed' and h > 168 then 'archive_old' when event_type <> 'purchase' and h > case when lim > 24 then lim + 24 else 24 end then 'archive_expired'
      when st = 'selected' and h * 60 >= 30 then 'release' else 'keep' end as action, count(*) n from e group by 1""")
@query
def queue_maintenance(spark, sf_dir):
    """What maintenance does with events as queue rows."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "selected").otherwise("ready")
    action = gates.maintained(status, F.col("ts"), F.col("event_type") == "purchase", _now(), F.when(F.col("user_id") % 2 == 0, 24).otherwise(168))
    return table(spark, sf_dir, "events").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@oracle("select l_orderkey, l_linenumber from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal >= 0)")
@query
def pointer_prune(spark, sf_dir):
    kept = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return gates.pruned(table(spark, sf_dir, "lineitem"), kept, "l_suppkey").select("l_orderkey", "l_linenumber")


@oracle("""select o_orderkey, floor(o_totalprice)::double as low, greatest(floor(o_totalprice), 2 * floor(o_totalprice))::double as high, (o_orderkey % 40)::int as posts from orders""")
@query
def salary_and_posts(spark, sf_dir):
    """Salary ranges and numbers of posts, from texts made of order prices."""
    price = F.floor("o_totalprice").cast("long")
    grouped = F.regexp_replace(F.format_number(price, 0), ",", " ")
    got = numbers.salary_range(F.concat(F.lit("from "), grouped, F.lit(" to "), (price * 2).cast("string"), F.lit(" MAD")))
    posts = numbers.positions(F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(" postes")))
    return table(spark, sf_dir, "orders").select("o_orderkey", got["low"].alias("low"), got["high"].alias("high"), posts.alias("posts"))


@oracle(r"""select page_id, case when contains(url, 'page=') then regexp_replace(regexp_replace(url, '#.*$', ''), 'page=[0-9]+', 'page=3') when contains(url, '?') then regexp_replace(url, '#.*$', '') || '&page=2'
    else regexp_replace(url, '#.*$', '') || '?page=2' end as next_page from pages""")
@query
def next_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", numbers.next_page(F.col("url")).alias("next_page"))


@oracle("""select p_type, arg_min(p_brand, (n, p_brand)) as choice from (select p_type, p_brand, count(*) n from part group by all) group by 1""")
@query
def least_used_choice(spark, sf_dir):
    """For every type the brand used least, ties by name."""
    counted = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return tables.top_k(counted, ["p_type"], 1, "n", "p_brand").select("p_type", F.col("p_brand").alias("choice"))


@oracle("""select event_type, count(*) n, (sum(round(value * 100)::bigint) // count(*))::bigint as mean_cents, arg_min(event_id, (value, event_id)) as fastest from events group by 1""")
@query
def provider_latency(spark, sf_dir):
    """Mean latency by kind, and its fastest call."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.floor(cents / F.count("*")).cast("long").alias("mean_cents"), F.min_by("event_id", F.struct("value", "event_id")).alias("fastest"))


@oracle("""select page_id, array_to_string(list_filter([url, 'https://x.example/b'], lambda u: u <> url), ' ') as blocked from pages where false union all select page_id, 'https://x.example/b' from pages""")
@query
def link_allow_list(spark, sf_dir):
    """Links that a page's allow-list, its own address, lacks."""
    blocked = gates.not_allowed(None, F.array("url", F.lit("HTTPS://X.example/b/?utm_source=q")), F.array(F.concat("url", F.lit("#part"))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(blocked, " ").alias("blocked"))


@oracle("""select user_id, case when p and e then 'comment_failed' when p then 'posted' when s then 'expired' when v then 'uncertain' when n >= 5 then 'failed' else 'pending' end as state from (
    select user_id, bool_or(event_type = 'purchase' and value > 100) p, bool_or(event_type = 'error' and value > 100) e, bool_or(event_type = 'signup' and value > 200) s,
    bool_or(event_type = 'view' and value > 150) v, count(*) filter (event_type = 'error') n from events group by 1)""")
@query
def delivery_states(spark, sf_dir):
    has = lambda kind, least: F.bool_or((F.col("event_type") == kind) & (F.col("value") > least))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(has("purchase", 100).alias("p"), has("error", 100).alias("e"), has("signup", 200).alias("s"), has("view", 150).alias("v"), F.count_if(F.col("event_type") == "error").alias("n"))
    return users.select("user_id", gates.delivery_state(F.col("p"), F.col("v"), F.col("n"), F.col("s"), F.col("e")).alias("state"))


@query
def page_state_json(spark, sf_dir):
    """The JSON object after a marker in every page, made of its address."""
    page = F.concat(F.lit("var a={}; window.state = {\"u\": {\"h\": \""), urls.host(F.col("url")), F.lit("\"}, \"n\": [1, {}]}; more"))
    return table(spark, sf_dir, "pages").select("page_id", F.get_json_object(numbers.json_after(page, "window.state"), "$.u.h").alias("host"))


SQL["page_state_json"] = SQL["host_rotation"].split(" from pages")[0].replace("select ", "select page_id, ", 1).rsplit(", max(page_id)", 1)[0] + " from pages"
