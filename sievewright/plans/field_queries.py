"""Queries of slugs, running means, fields by layers and rewritten pages, each beside its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import slugs, times
from ..operators import fields, html, rewrite, speed
from .catalogue import query, spread, table
from .gate_queries import oracle

_TITLES = ("وزارة الصحة", "Ingénieur réseaux & sécurité", "أستاذ محاضر", "Straße ﬁn Ænd 日本 Ⅳ", "مهندسٌ", "", "Chargé(e) d'études 2026", "شركة غذاء ذهب خبز ظل ثلج")
_STEMS = ("wzara-alsha", "ingenieur-reseaux-securite", "astadh-mhadr", "strae-fin-nd-iv", "mhnds", "", "charge-e-d-etudes", "shrka-ghdhaa-dhhb-khbz-zl-thlj")
_ENGLISH = ("ministry", "engineer-network-security", "lecturer", "strae-fin-nd", "engineer", "", "charge-etudes", "")


@oracle(f"""with p as (select p_partkey, p_name, {list(_STEMS)}[p_partkey % 8 + 1] as s, {list(_ENGLISH)}[p_partkey % 8 + 1] as e, trim(regexp_replace(lower(p_name), '[^a-z]+', '-', 'g'), '-') as n from part),
    w as (select *, list_filter(string_split(n || '-' || s, '-'), lambda x: x <> '') as ws, list_filter(string_split(n, '-'), lambda x: length(x) > 1 and x not in {slugs.STOP}) as nw from p),
    d as (select *, list_distinct(list_slice(nw, 1, 2) || list_filter(list_slice(string_split(e, '-'), 1, 3), lambda x: x <> '') || ['rabat']) as found, list_slice(nw, 1, 2) || list_filter(list_slice(string_split(e, '-'), 1, 3), lambda x: x <> '') || ['rabat'] as kept from w)
    select p_partkey, array_to_string(list_slice(ws, 1, 8), '-') as stem, array_to_string(list_filter(kept, lambda x, i: list_position(kept, x) = i), '-') as english from d""")
@query
def arabic_slugs(spark, sf_dir):
    """Stems of every part's name and a title of one of eight scripts and spellings, and their English words."""
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 8).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", slugs.stem(F.col("p_name"), title).alias("stem"), slugs.english_stem(F.col("p_name"), title, F.lit("الرباط")).alias("english"))


@oracle("""with s as (select event_type || ':' || user_id % 7 as candidate, count(*) as successes, sum(round(value::decimal(18,6), 4)) as total, max(ts) as last_at from events where event_type <> 'error' group by 1)
    select candidate, successes, round(total::double / successes, 4) as mean, candidate = first_value(candidate) over (order by round(total::double / successes, 4), candidate) as fastest, epoch_us(last_at) as last_us from s""")
@query
def running_means(spark, sf_dir):
    """Means of candidates' times from three batches merged one by one."""
    calls = table(spark, sf_dir, "events").filter("event_type <> 'error'").withColumn("candidate", F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string")))
    batches = [speed.summed(calls.filter(F.col("event_id") % 3 == i), "candidate", "value", "ts") for i in range(3)]
    found = speed.means(reduce(speed.merged, batches))
    return found.select("candidate", "successes", F.col("mean").cast("double").alias("mean"), "fastest", times.micros(F.col("last_at")).alias("last_us"))


@oracle("""with c as (select *, c_custkey % 4 as k, c_custkey % 3 as j from customer)
    select c_custkey, 'title' as field, case when k = 0 then 'Row ' || c_custkey else 'Role ' || c_custkey end as value, case when k = 0 then 'row' else 'structured' end as origin from c
    union all select c_custkey, 'company', case when k = 1 then c_name when j = 0 then 'Label ' || c_nationkey else 'Source' end, case when k = 1 then 'structured' when j = 0 then 'label' else 'source' end from c
    union all select c_custkey, 'location', 'Rabat, Salé / Fès', 'structured' from c where k in (1, 2)
    union all select c_custkey, 'country', 'MA', 'structured' from c where k in (1, 2)
    union all select c_custkey, 'salary', case when k = 1 then c_nationkey || '-100 MAD MONTH' else c_nationkey || ' EUR' end, 'structured' from c where k in (1, 2)
    union all select c_custkey, 'deadline', case when k = 1 then '2026-01-02' else '05/06/2026' end, case when k = 1 then 'structured' else 'label' end from c where k = 1 or j < 2
    union all select c_custkey, 'published', '2025-12-01', 'structured' from c where k > 0
    union all select c_custkey, 'contract', case when k = 1 then 'FULL_TIME, INTERN' else 'FULL_TIME' end, 'structured' from c where k in (1, 2)
    union all select c_custkey, 'reference', 'R' || c_custkey, 'structured' from c where k > 0
    union all select c_custkey, 'remote', 'true', 'structured' from c where k = 2""")
@query
def extracted_fields(spark, sf_dir):
    """Fields of a page of each customer, from structured data where it has them, else from labels, its row or its source."""
    key, k, j = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4, F.col("c_custkey") % 3
    pay = F.when(k == 1, F.concat(F.lit('{"currency":"MAD","value":{"minValue":'), F.col("c_nationkey").cast("string"), F.lit(',"maxValue":100,"unitText":"MONTH"}}'))).otherwise(F.concat(F.lit('{"currency":"EUR","value":'), F.col("c_nationkey").cast("string"), F.lit("}")))
    places = F.lit('"jobLocation":[{"address":{"addressLocality":"Rabat","addressRegion":"Salé","addressCountry":{"name":"MA"}}},{"address":{"addressLocality":"Fès"}},{"address":{"addressLocality":"Fès"}},7]')
    full = F.concat(
        F.lit('{"@context":"x","@graph":[{"@type":"Thing"},{"@type":["JobPosting"],"title":"Role '), key, F.lit('","datePosted":"2025-12-01","identifier":'),
        F.when(k == 1, F.concat(F.lit('{"value":"R'), key, F.lit('"}'))).when(k == 2, F.concat(F.lit('[{"name":"R'), key, F.lit('"}]'))).otherwise(F.concat(F.lit('"R'), key, F.lit('"'))),
        F.when(k == 1, F.concat(F.lit(',"hiringOrganization":[{"name":"'), F.col("c_name"), F.lit('"}],"validThrough":"2026-01-02","employmentType":["FULL_TIME","INTERN"]'))).when(k == 2, F.lit(',"hiringOrganization":"x","validThrough":"2125-12-01","employmentType":"FULL_TIME","jobLocationType":"telecommute"')).otherwise(""),
        F.when(k.isin(1, 2), F.concat(F.lit(',"baseSalary":'), pay, F.lit(","), places)).otherwise(""), F.lit("}]}"),
    )
    labels = F.concat(F.when(j == 0, F.concat(F.lit("<p>Employeur : Label "), F.col("c_nationkey").cast("string"), F.lit("</p><p>Employeur : second</p>"))).otherwise(""), F.when(j < 2, F.lit("<ul><li>Date limite: 05/06/2026<li>Other: x</ul>")).otherwise(""))
    page = F.concat(F.lit("<html><head><script type='application/ld+json'>"), F.when(k > 0, full).otherwise("{broken"), F.lit("</script></head><body>"), labels)
    customers = table(spark, sf_dir, "customer")
    parsed = html.parsed(customers.select("c_custkey", page.alias("page")), "c_custkey", "page")
    found = fields.merged(
        "c_custkey", fields.from_page(parsed, "c_custkey", "nodes", "blocks", {"company": "employeur|company", "deadline": r"date\s+limite|deadline"}),
        fields.from_row(customers, "c_custkey", {"title": F.concat(F.lit("Row "), key), "country": F.lit(" ")}), fields.from_row(customers, "c_custkey", {"company": F.lit("Source")}, "source"),
    )
    return found.select("c_custkey", "field", "value", "origin")


@oracle("""select c_custkey, '<table><tr><td>A<td>b</tr></table><h2>Facts</h2><p>Line ' || c_custkey || ' &amp; co</p>' || case when c_custkey % 2 = 0
        then '<p>نص <a href="https://hub.example/jobs">العمل</a> هنا<p>x <a href="/apply?a=1&amp;b=2#top" class="k button extL jobApplyButton" target="_blank" rel="nofollow noreferrer noopener" role="button">go</a>'
        else '<p><a href="/x">العمل</a><div class="actionBox"><a class="button extL jobApplyButton" href="/apply?a=1&amp;b=2" target="_blank" rel="nofollow noreferrer noopener">Apply</a></div>' end
    || '<p><a class="extL jobOfficialDetailLink" href="https://d.example/' || c_custkey || '" target="_blank" rel="nofollow noreferrer noopener">Detail</a></p>'
    || case when c_custkey % 2 = 0 then '' else '<p>للاطلاع على المزيد، راجع <a href="https://hub.example/jobs">قسم الوظائف</a>.</p>' end
    || '<figure><img src="https://i.example/1.png" alt="Page 1"></figure>' as html from customer""")
@query
def rewritten_pages(spark, sf_dir):
    """A generated page of each customer after the five rewriters: internal and empty rows, action links, the hub's link, page images."""
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    odd = F.when(k == 0, F.lit("<tr><th>Salary</th><td> 0 </td></tr>")).when(k == 1, F.lit("<tr><td>Référence</td><td>العمل 7</td></tr>")).otherwise("<tr><td><b>تاريخ النشر</b><td>2024")
    own = F.when(F.col("c_custkey") % 2 == 0, F.lit("<p>نص العمل هنا<p>x <a href='/apply?a=1&amp;b=2#top' class=k>go</a>")).otherwise('<p><a href="/x">العمل</a>')
    page = F.concat(F.lit("<table><tr><td>A<td>b</tr>"), odd, F.lit("</table><h2>Facts</h2><h3>المصدر:</h3><p>Line "), key, F.lit(" &amp; co</p>"), own)
    links = F.array(
        F.struct(F.lit("apply").alias("kind"), F.lit("Apply").alias("label"), F.lit("/apply?a=1&b=2").alias("url")),
        F.struct(F.lit("detail").alias("kind"), F.lit("Detail").alias("label"), F.concat(F.lit("https://d.example/"), key).alias("url")),
    )
    images = F.array(*(F.struct(F.lit("https://i.example/1.png").alias("url"), F.lit("Page 1").alias("alt")) for _ in range(2)))
    pages = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", page.alias("html"), links.alias("links"), images.alias("images"), F.lit("https://hub.example/jobs").alias("hub"))
    return rewrite.rewritten(pages, "html", "links", "images", "hub").select("c_custkey", "html")
