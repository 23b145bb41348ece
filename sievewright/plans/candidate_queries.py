"""Queries of the candidates: orders as vacancies, their lines as action links and documents, beside their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, identity, tables
from .catalogue import query, table
from .gate_queries import oracle

_NOW = "1998-06-01 12:00:00"
_RETIRED = ("nation_3", "nation_17")


def _now():
    return F.lit(_NOW).cast("timestamp")


def _candidates(spark, sf_dir):
    """An order as a vacancy: its customer is the employer, its priority tells the form of its application address."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity", "l_partkey")).alias("lines"))
    o = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    price, account, status, priority, segment = (F.col(c) for c in ("o_totalprice", "c_acctbal", "o_orderstatus", "o_orderpriority", "c_mktsegment"))
    host = F.concat(F.lit("h"), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") < 8, ".gov.ma").otherwise(".example"))
    ref = lambda more: (F.col("o_orderkey") + more).cast("string")
    at = lambda *tail: F.concat(F.lit("https://www."), host, *tail)
    detail = at(F.lit("/jobs/"), ref(1_000))
    low = F.when(status == "F", F.concat(F.lit("mailto:HR@"), host, F.lit("?subject=job"))).when(status == "O", at(F.lit("/login/jobs/"), ref(1_000))).otherwise(F.lit("by post"))
    apply_ = (
        F.when(priority == "1-URGENT", F.concat(detail, F.lit("/apply")))
        .when(priority == "2-HIGH", F.when(account < 0, at(F.lit("/jobs/"), ref(1_001))).otherwise(detail))
        .when(priority == "3-MEDIUM", at(F.lit("/portal")))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("https://www.rekrute.com/offres/"), ref(1_000)))
        .otherwise(low)
    )
    shown = lambda line: F.struct(
        F.when(line["l_returnflag"] == "R", "info").otherwise("Apply").alias("kind"),
        F.when(line["l_quantity"] > 25, F.concat(apply_, F.lit("?utm_source=line"))).otherwise(F.concat(F.lit("https://other.example/jobs/"), line["l_partkey"].cast("string"))).alias("url"),
    )
    day = F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "c_nationkey", F.col("n_name").alias("source"), F.lower("n_name").isin(*_RETIRED).alias("retired"),
        F.element_at(F.array(*map(F.lit, ("S+", "S", "A+", "A", "B"))), F.col("n_regionkey") + 1).alias("source_priority"),
        F.when(price < 30_000, F.lit(" Careers! ")).otherwise(F.concat(F.lit("Clerk "), F.regexp_replace("n_name", "_", " "))).alias("title"), F.concat(F.lit("Employer "), segment).alias("company"),
        F.when((status != "P") | (account >= 0), detail).alias("url"), detail.alias("detail_url"), apply_.alias("apply_url"), F.concat(F.lit("hr@"), host).alias("apply_email"), (price > 100_000).alias("email_verified"),
        F.when(segment == "AUTOMOBILE", "direct_apply").when(segment == "BUILDING", "official_application_channel").when(segment == "FURNITURE", "official_job_page").alias("link_kind"),
        F.when(account > 5_000, "official_pdf").alias("apply_source"), F.when(status == "O", "competition").when(status == "P", "result").alias("notice_type"),
        F.when(segment != "HOUSEHOLD", "morocco").alias("eligibility"), F.when(segment == "AUTOMOBILE", "job").otherwise("training").alias("kind"), F.when((segment == "AUTOMOBILE") & (account > 8_000), "above_limit").alias("education"),
        F.col("n_name").alias("location"), F.when(segment == "MACHINERY", "bac+2").alias("diploma"), F.when(price > 200_000, price.cast("string")).alias("salary"),
        (account > 0).alias("official"), F.lit(None).cast("boolean").alias("needs_account"), ((status == "P") & (account > 5_000)).alias("rolling"), (F.year("o_orderdate") % 2 == 0).alias("entry_level"), F.lit(False).alias("date_only"),
        F.floor(price / 2_000).cast("int").alias("positions"), F.when(status != "P", F.date_add(F.col("o_orderdate").cast("date"), 20).cast("timestamp")).alias("deadline"),
        F.when(price >= 20_000, F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), day)).alias("published"), day.alias("discovered"),
        F.when(segment == "MACHINERY", 4).when(segment == "HOUSEHOLD", 2).otherwise(0).alias("focus"), F.when(F.col("n_regionkey") == 0, "ma").alias("country"), (account < 0).alias("remote"), F.lit(None).cast("boolean").alias("visa"),
        F.transform("lines", shown).alias("actions"), F.when(price > 150_000, F.array(F.concat(F.lit("Apply at "), F.upper(apply_), F.lit("/ until the end.")))).alias("document_texts"),
    )


# the same candidates, told by what each rule is about and not by addresses
_ROWS = f"""
    x as (select l_orderkey, bool_or(l_returnflag <> 'R' and l_quantity > 25) as shown from lineitem group by 1),
    o as (select o_orderkey k, o_custkey, o_orderstatus st, o_orderpriority pri, o_totalprice price, c_acctbal acct, c_mktsegment seg, c_nationkey nk, n_name, n_regionkey rk, coalesce(shown, false) as shown,
        case when o_orderstatus <> 'P' then o_orderdate + interval 20 day end as dl, case when o_totalprice >= 20000 then o_orderdate + (o_orderkey % 24) * interval 1 hour end as pub, o_orderdate as disc, timestamp '{_NOW}' as now
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join x on o_orderkey = l_orderkey),
    p as (select *, pri = '3-MEDIUM' and st = 'O' and acct > 0 and shown as portal, (epoch_us(now) - epoch_us(pub)) / 3600000000.0 as age, case when seg = 'AUTOMOBILE' then 24 else 720 end as lim, floor(price / 2000)::int as positions,
        case when seg = 'MACHINERY' then 4 when seg = 'HOUSEHOLD' then 2 else 0 end as focus, (epoch_us(dl) - epoch_us(now)) / 86400000000.0 as days from o),
    b as (select *, case when pri = '5-LOW' and st = 'F' then price > 100000 and acct > 0 when pri = '5-LOW' and st = 'P' then false when pri = '3-MEDIUM' then portal else not (pri = '2-HIGH' and acct < 0) end as bound,
        case when n_name in ('NATION_3', 'NATION_17') then 'retired_source'
          when pri = '5-LOW' and st = 'F' then case when price > 100000 and acct > 0 then '' else 'mail_not_verified' end
          when pri = '5-LOW' and st = 'P' then 'no_direct_address' when pri = '5-LOW' then 'sign_in_page'
          when seg = 'BUILDING' then case when not portal then 'portal_not_verified' when acct > 5000 and price <= 150000 then 'portal_not_in_document' else '' end
          when seg = 'FURNITURE' then 'not_an_action' when pri = '3-MEDIUM' or (pri = '2-HIGH' and acct < 0) then 'generic_or_other_vacancy' when pri = '2-HIGH' then 'description_page'
          when not (shown or seg = 'AUTOMOBILE' or pri = '1-URGENT') then 'no_apply_action' when pri = '4-NOT SPECIFIED' and not shown then 'account_not_verified' else '' end as refusal,
        coalesce(age >= 0 and age <= lim, false) as fresh,
        case when st = 'P' then 'normal' when days < 0 then 'expired' when acct > 0 and days <= 2 then 'critical' when acct > 0 and positions >= 100 and (days is null or days <= 7) then 'high' when acct > 0 and positions >= 20 then 'elevated' else 'normal' end as urgency from p),
    s as (select *, {{'official': 25 * (acct > 0)::int, 'fresh': 15 * fresh::int, 'very_fresh': 10 * (fresh and age <= 12)::int, 'focus': 3 * (focus > 0)::int, 'priority': 10 * (rk <= 2)::int, 'many_positions': 10 * (positions >= 10)::int,
          'deadline': 10 * (dl is not null)::int, 'location': 5, 'diploma': 5 * (seg = 'MACHINERY')::int, 'application': 10 * bound::int, 'salary': 5 * (price > 200000)::int, 'entry_level': 5 * (year(disc) % 2 = 0)::int}} as pts,
        seg = 'AUTOMOBILE' and acct > 8000 as above, st = 'P' and acct < 0 as no_page from b),
    c as (select *, least(100, pts.official + pts.fresh + pts.very_fresh + pts.focus + pts.priority + pts.many_positions + pts.deadline + pts.location + pts.diploma + pts.application + pts.salary + pts.entry_level) as score,
        concat_ws(',', case when seg = 'HOUSEHOLD' then 'eligibility_unknown' end, case when no_page then 'no_page' end, case when not bound then 'no_application' end, case when pub is null then 'publication_unknown' end,
          case when age < 0 then 'published_in_future' end, case when age >= 0 and not fresh then 'too_old' end, case when price < 30000 then 'list_page' end, case when st <> 'P' and dl < now then 'expired' end,
          case when dl is null and not (st = 'P' and acct > 5000) then 'no_deadline' end, case when dl <= now then 'deadline_passed' end, case when above then 'over_qualified' end, nullif(refusal, '')) as reasons,
        coalesce(dl <= now, false) or above or coalesce(age < 0, false) or coalesce(age >= 0 and not fresh, false) or no_page or price < 30000 as final from s)"""


@oracle(f"with {_ROWS} select k as o_orderkey, bound, refusal from c")
@query
def application_refusals(spark, sf_dir):
    """Why each application address is refused, of eleven reasons, and whether it belongs to its vacancy."""
    return candidates.applied(_candidates(spark, sf_dir)).select("o_orderkey", "bound", "refusal")


@oracle(f"""with {_ROWS} select k as o_orderkey, score, reasons, case when reasons = '' then 'publish' when final then 'reject' else 'queue' end as standing,
    concat_ws(',', {", ".join(f"'{n}=' || pts.{n}" for n in ("official", "fresh", "very_fresh", "focus", "priority", "many_positions", "deadline", "location", "diploma", "application", "salary", "entry_level"))}) as points from c""")
@query
def candidate_assessment(spark, sf_dir):
    """All twelve indicators with their points, the score, all reasons and the standing."""
    got = candidates.assessed(_candidates(spark, sf_dir), _now())
    points = F.array_join(F.transform(F.map_entries("points"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select("o_orderkey", "score", F.array_join("reasons", ",").alias("reasons"), "standing", points.alias("points"))


@oracle(f"""with {_ROWS}, v as (select n_name, max(disc) as served from c where st = 'F' group by 1)
    select k as o_orderkey, nk as c_nationkey, score, row_number() over w as place from c left join v using (n_name)
    window w as (partition by nk order by case urgency when 'critical' then 2 when 'high' then 2 when 'elevated' then 1 else 0 end desc, coalesce(epoch_us(served), 0), coalesce(epoch_us(pub), 0) desc, focus desc, epoch_us(disc) desc, score desc, k)
    qualify row_number() over w <= 3""")
@query
def next_candidates(spark, sf_dir):
    """Three candidates of each nation by all keys of the selection."""
    got = candidates.assessed(_candidates(spark, sf_dir), _now())
    served = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("_nation")).agg(F.max("o_orderdate").cast("timestamp").alias("served"))
    ranked = got.join(served, F.col("c_nationkey") == F.col("_nation"), "left")
    best = tables.top_k(ranked, ["c_nationkey"], 3, *candidates.selection_order(F.col("served"), F.col("o_orderkey"), _now()), rank="place")
    return best.select("o_orderkey", "c_nationkey", "score", "place")


@oracle(f"""with {_ROWS}, d as (select *, case when dl is null then 0.0 when days <= 1 then 30.0 when days <= 2 then 26.0 when days <= 3 then 22.0 when days <= 7 then 16.0 when days <= 14 then 10.0 else 4.0 end as due,
        least(14.0::double, greatest(0.0::double, coalesce((epoch_us(now) - epoch_us(pub)) / 86400000000.0::double, 0.0))) as waited, case urgency when 'critical' then 4.0 when 'high' then 3.0 when 'elevated' then 1.5 else 0.0 end as boost from c),
    e as (select *, due::double + waited + boost::double as points from d)
    select k as o_orderkey, o_custkey, points from e qualify row_number() over (partition by o_custkey order by points desc, due desc, waited desc, score desc, positions desc, case when pub is null then 0 else -epoch_us(pub) end desc, k) = 1""")
@query
def next_social_posts(spark, sf_dir):
    """Each customer's article that is posted next: deadline, waiting and urgency, then the other keys."""
    got = candidates.assessed(_candidates(spark, sf_dir), _now()).withColumn("social", candidates.social_points(F.col("published"), _now()))
    best = tables.top_k(got, ["o_custkey"], 1, *candidates.social_order(F.col("social"), F.col("published"), F.col("o_orderkey")))
    return best.select("o_orderkey", "o_custkey", F.col("social.points").alias("points"))


@oracle(f"""with {_ROWS} select k as o_orderkey from c order by case when dl is null then 0 when days < 0 then -1 when days <= 1 then 6 when days <= 3 then 5 when days <= 7 then 4 when days <= 14 then 3 when days <= 30 then 2 else 1 end desc, focus desc,
    epoch_us(coalesce(pub, disc)) desc, case st when 'O' then 3 when 'F' then 4 else 0 end desc, greatest(score, (price / 10000)::int * 10) desc, 6 - rk - (rk = 4)::int + 2 * (acct > 0)::int desc, k limit 12""")
@query
def enrichment_batch(spark, sf_dir):
    """The twelve pages that are read next, by all keys."""
    got = candidates.assessed(_candidates(spark, sf_dir), _now()).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_key"), F.round(F.col("o_totalprice") / 10_000).cast("int").alias("queue_score")), F.col("o_orderkey") == F.col("_key"))
    status = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "F", "selected").otherwise("new")
    return got.orderBy(*candidates.enrichment_order(status, F.col("queue_score"), F.col("o_orderkey"), _now())).limit(12).select("o_orderkey")


def _campaigns(spark, sf_dir):
    """Orders as campaigns with all nine compared columns; their line's flags are documents."""
    papers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    o = table(spark, sf_dir, "orders").join(papers, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tracked = F.when(key % 2 == 1, F.lit("?utm_source=mail")).otherwise(F.lit(""))
    return o.select(
        "o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 100_000).cast("int").alias("positions"), F.year("o_orderdate").cast("string").alias("deadline"), F.when(F.col("o_totalprice") > 250_000, " high ").alias("salary"),
        F.col("o_orderpriority").alias("contract"), F.concat(F.lit(" "), F.month("o_orderdate").cast("string")).alias("location"),
        F.concat(F.when(key % 2 == 1, "http://WWW.").otherwise("https://"), F.lit("h.example/jobs/"), F.col("o_custkey").cast("string"), F.lit("/"), F.quarter("o_orderdate").cast("string"), tracked).alias("apply_url"),
        F.when(status == "O", "competition").when((status == "F") & (key % 2 == 0), "vacancy").when(status == "P", "result").alias("notice_type"), F.when(status == "P", "closed").alias("notice_status"),
        F.transform("flags", lambda f: F.concat(F.lit("https://www.h.example/doc/"), f, F.lit(".pdf"), tracked)).alias("document_urls"),
        F.when(key % 4 < 2, status).alias("signature"), (key % 7).cast("int").alias("strength"), (key % 5 > 0).alias("complete"),
    )


@oracle("""with f as (select l_orderkey, string_agg(distinct l_returnflag, '|' order by l_returnflag) flags from lineitem group by 1), o as (select *, coalesce(flags, '') fl from orders left join f on o_orderkey = l_orderkey),
    r as (select * from o where o_orderkey % 2 = 0 qualify row_number() over (partition by o_custkey order by o_orderkey) = 1),
    j as (select a.o_orderkey article_id, r.o_orderkey campaign_id, concat_ws(',', case when floor(a.o_totalprice / 100000) <> floor(r.o_totalprice / 100000) then 'positions' end, case when year(a.o_orderdate) <> year(r.o_orderdate) then 'deadline' end,
        case when (a.o_totalprice > 250000) <> (r.o_totalprice > 250000) then 'salary' end, case when a.o_orderpriority <> r.o_orderpriority then 'contract' end, case when month(a.o_orderdate) <> month(r.o_orderdate) then 'location' end,
        case when quarter(a.o_orderdate) <> quarter(r.o_orderdate) then 'apply_url' end, case when a.o_orderstatus <> r.o_orderstatus then 'notice_type' end, case when (a.o_orderstatus = 'P') <> (r.o_orderstatus = 'P') then 'notice_status' end,
        case when a.fl <> r.fl then 'document_urls' end) as changed,
        a.o_orderkey % 5 > 0 and a.o_orderkey % 4 < 2 and r.o_orderkey % 4 < 2 and a.o_orderstatus <> r.o_orderstatus and least(a.o_orderkey % 7, r.o_orderkey % 7) >= 4 as evidence
      from o a join r on a.o_custkey = r.o_custkey where a.o_orderkey % 2 = 1)
    select article_id, campaign_id, changed, changed <> '' or evidence as material from j""")
@query
def material_changes(spark, sf_dir):
    """In which of nine columns each odd order departs from its customer's first even one."""
    rows = _campaigns(spark, sf_dir)
    first = tables.keep_first(rows.filter("o_orderkey % 2 = 0"), ["o_custkey"], "o_orderkey").alias("r")
    met = rows.filter("o_orderkey % 2 = 1").alias("a").join(first, F.col("a.o_custkey") == F.col("r.o_custkey"))
    material = identity.material_change(identity.COMPARED)
    return met.select(F.col("a.o_orderkey").alias("article_id"), F.col("r.o_orderkey").alias("campaign_id"), F.array_join(identity.changed_columns(), ",").alias("changed"), F.coalesce(material, F.lit(False)).alias("material"))


@oracle(f"""with {_ROWS}, d as (select k, case when k % 3 = 0 then 'update' when k % 3 = 1 then 'new_campaign' when st = 'P' then 'hold' else 'duplicate' end as action from c where st <> 'F')
    select c.k as o_orderkey, coalesce(action, 'new') as action, urgency,
      case when action = 'update' then (c.k + 1)::varchar when coalesce(action, 'new') in ('new', 'new_campaign') then left(sha256('campaign|' || c.k), 16) end as campaign_id,
      concat_ws(',', 'jobs', case when seg <> 'AUTOMOBILE' then 'training' end, case when rk = 0 or seg <> 'HOUSEHOLD' then 'jobs-morocco' when acct < 0 then 'remote-jobs' else 'jobs-abroad' end) as labels,
      'employer-' || lower(seg) || case when price < 30000 then '-careers' else '-clerk-nation' end as slug from c left join d using (k)""")
@query
def prepared_candidates(spark, sf_dir):
    """Candidates with the columns that a publication needs; decisions come from orders that are not finished."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    action = F.when(key % 3 == 0, "update").when(key % 3 == 1, "new_campaign").when(status == "P", "hold").otherwise("duplicate")
    decisions = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", action.alias("action"), (key + 1).alias("campaign_id"))
    got = candidates.prepared(_candidates(spark, sf_dir), decisions, "o_orderkey", _now())
    return got.select("o_orderkey", "action", "urgency", "campaign_id", F.array_join("labels", ",").alias("labels"), "slug")
