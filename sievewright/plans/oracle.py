"""Independent DuckDB formulations of the registered queries, by the same names.

Left out: queries over a parsed HTML tree of unknown markup, which SQL cannot express.  The streams' oracles
give what the streams come to once all is processed.  Names, patterns and limits in the SQL are the fixed values of
``functions`` and ``operators``.
"""

from __future__ import annotations

_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
_HOST = f"regexp_replace(lower(regexp_extract(url, {_URL}, 2)), '^www\\.', '')"
_PATH = f"coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, {_URL}, 3), '/{{2,}}', '/', 'g'), '/+$', ''), ''), '/')"
_PAIRS = f"list_filter(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda p: p <> '')"
_JOB_DROPPED = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','mc_cid','mc_eid','trk','ref','source')"
_DROPPED = "('fbclid','gclid','dclid','gbraid','wbraid','mc_cid','mc_eid','igshid','ref','ref_src','cmpid','ocid','spm')"
_JOB_TAIL = f"array_to_string(list_sort(list_filter({_PAIRS}, lambda p: lower(split_part(p, '=', 1)) not in {_JOB_DROPPED})), '&')"
_TAIL = f"array_to_string(list_filter({_PAIRS}, lambda p: lower(split_part(p, '=', 1)) not in {_DROPPED} and not starts_with(lower(split_part(p, '=', 1)), 'utm_')), '&')"
_JOB_URL = f"'https://' || {_HOST} || {_PATH} || case when {_JOB_TAIL} = '' then '' else '?' || {_JOB_TAIL} end"
_REFERENCE = f"""coalesce(
  (select lower(split_part(p, '=', 2)) from (select unnest({_PAIRS}) p) where lower(split_part(p, '=', 1)) = 'id' limit 1),
  nullif(regexp_extract(lower({_PATH}), '/requisition/(\\d{{2,}})(?:/|$)', 1), ''),
  nullif(regexp_extract(lower({_PATH}), '/jobs?/(\\d{{3,}})(?:/|$)', 1), ''), '')"""

_LINE = "split_part(text, chr(10), 1)"
_CLEAN_LINE = "trim(regexp_replace(lower(" + _LINE + r"), '\s+', ' ', 'g'))"
_TITLE_HASH = r"substr(sha1(regexp_replace(" + _CLEAN_LINE + r", '[^\p{L}\p{N}_ ]+', '', 'g')), 1, 16)"
_STOP = "('the','a','an','and','or','to','of','for','in','on','with','by','from','as','is','are','new','news','report','says','how','why','what','this','that','after','over','into','about','best','top')"
_TOPIC_TEXT = r"regexp_replace(lower(" + _LINE + r"), '[^\p{L}\p{N}_ .-]+', ' ', 'g')"
_KEYWORDS = f"""
  select doc_id, list_slice(list(w order by pos), 1, 8) as kw from (
    select doc_id, w, min(pos) pos from (
      select doc_id, trim(w0, '.-') w, pos from (
        select doc_id, unnest(ws) w0, unnest(range(1, len(ws) + 1)) pos from (select doc_id, regexp_extract_all({_TOPIC_TEXT}, '[a-z0-9][a-z0-9.-]{{2,}}') ws from documents)))
    where length(w) >= 3 and w not in {_STOP} group by doc_id, w) group by doc_id"""
_ORDERS = "(select *, date_diff('day', o_orderdate::date, date '2001-09-01') age_days from orders join customer on o_custkey = c_custkey)"
_DEADLINE = "case when h < 0 then 0 when h <= 24 then 30 when h <= 48 then 26 when h <= 72 then 22 when h <= 168 then 16 when h <= 336 then 10 else 4 end"

_MARK = "(select epoch_us(max(ts)) // 1000 - 3600000 from events)"
_CIRCUIT_STEPS = """
    o as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn, epoch_us(ts) as us, ['slow', 'public', 'x'][user_id % 3 + 1] as host,
        case when event_type in ('error', 'click') then ['timeout', '429', '403', 'other'][event_id % 4 + 1] else 'success' end as outcome from events),
    s as (select user_id, 0::bigint as rn, 0 as failures, 0::bigint as until, 0::bigint as was, null::bigint as us, '' as outcome, 0 as minutes, 0 as fell from (select distinct user_id from events)
        union all select user_id, rn, case when outcome = 'success' then 0 else f end, case when outcome = 'success' then 0 when minutes > 0 then greatest(open_until, us + minutes::bigint * 60000000) else open_until end, was, us, outcome, minutes, f from (
            select *, case when outcome = 'success' then 0 when outcome = '429' then 60 when outcome = '403' then 180
                when outcome = 'timeout' then case host when 'slow' then case when f >= 5 then 30 when f >= 2 then 15 else 5 end when 'public' then case when f >= 5 then 15 when f >= 2 then 10 else 5 end else 30 end
                when f >= 3 then 45 else 0 end as minutes from (
                select o.user_id, o.rn, o.us, o.outcome, o.host, s.failures + (o.outcome <> 'success')::int as f, s.until as was, case when s.until < o.us then 0 else s.until end as open_until
                from s join o on s.user_id = o.user_id and o.rn = s.rn + 1)))"""

SQL: dict[str, str] = {
    "reread_timers": f"""with recursive e as (select user_id, epoch_us(ts) as us from events),
        opened as (select user_id, min(us) as us from e group by user_id
            union all select o.user_id, (select min(e.us) from e where e.user_id = o.user_id and e.us >= o.us + 86400000000) from opened o where o.us is not null)
        select user_id::varchar as key, us as opened_us, m::int as minutes, us + m::bigint * 60000000 as due_us from opened, unnest([20, 360, 1440]) x(m)
        where us is not null and -((-(us + m::bigint * 60000000)) // 1000) <= {_MARK}""",
    "circuit_timers": f"""with recursive {_CIRCUIT_STEPS},
        told as (
            select user_id, 'closed' as kind, was as at_us, was as until_us, lag(failures) over (partition by user_id order by rn) as failures from s qualify rn > 0 and was > 0 and us > was
            union all select user_id, 'closed', us, was, lag(failures) over (partition by user_id order by rn) from s qualify rn > 0 and was > 0 and us <= was and outcome = 'success'
            union all select user_id, 'open', us, until, failures from s where rn > 0 and outcome <> 'success' and minutes > 0
            union all select user_id, 'closed', until, until, failures from s qualify until > 0 and rn = max(rn) over (partition by user_id) and -((-until) // 1000) <= {_MARK})
        select user_id::varchar as source, kind, at_us, until_us, failures from told""",
    "table_facts": """select o_custkey as c_custkey, 'priority' as category, o_orderpriority as value, 'table_column' as origin, 'high' as confidence from orders
        union all select o_custkey, 'due', strftime(o_orderdate, '%Y-%m-%d'), 'table_column', 'high' from orders
        union all select c_custkey, 'segment', c_mktsegment, 'table_label', 'high' from customer where c_custkey in (select o_custkey from orders)""",
    "url_canonical": f"""select page_id, lower(regexp_extract(url, {_URL}, 1)) || '://' || lower(regexp_extract(url, {_URL}, 2)) || {_PATH}
        || case when {_TAIL} = '' then '' else '?' || {_TAIL} end as canonical from pages""",
    "job_url_canonical": f"select page_id, {_JOB_URL} as canonical, {_HOST} || {_PATH} as link_key from pages",
    "url_reference": f"""select page_id, reference, reference <> '' or regexp_matches(last, '[0-9]{{3,}}') or regexp_matches(last, '[A-Za-z]+-[A-Za-z]+-[A-Za-z]+') as specific
        from (select page_id, {_REFERENCE} as reference, list_extract(string_split({_PATH}, '/'), -1) as last from pages)""",
    "url_dedup_keep_first": f"""select host, count(*) n, min(page_id) first_page from (
        select page_id, {_HOST} host, row_number() over (partition by {_JOB_URL} order by page_id) r from pages) where r = 1 group by host""",
    "host_rotation": f"select {_HOST} as host, max(page_id) as last_page from pages group by 1",
    "likely_articles": f"""select page_id, title from (select page_id, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ') as title from pages)
        where length(title) >= 8 and {_PATH} <> '/' and not regexp_matches(lower({_PATH}), '\\.(jpe?g|png|gif|svg|webp|css|js|ico|pdf|zip)$')""",
    "title_hash": f"select doc_id, {_TITLE_HASH} as title_hash from documents",
    "topic_keywords": f"select d.doc_id, coalesce(array_to_string(kw, ' '), '') as keywords from documents d left join ({_KEYWORDS}) k using (doc_id)",
    "topic_signature": f"""select d.doc_id, case when kw is null then {_TITLE_HASH} else substr(sha1(array_to_string(list_sort(kw), ' ')), 1, 20) end as signature
        from documents d left join ({_KEYWORDS}) k using (doc_id)""",
    "content_hash_dups": r"""select substr(sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 24) as content_hash, count(*) n, min(doc_id) first_doc
        from documents group by 1 having count(*) > 1""",
    "word_counts": r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::int as words from documents",
    "repeated_blocks": r"""select distinct doc_id from (
        select doc_id, substr(regexp_replace(lower(c), '[^\p{L}\p{N}_]+', '', 'g'), 1, 180) f from (
          select doc_id, trim(unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.!?]\s+', chr(10), 'g'), chr(10)))) c from documents)
        where length(c) >= 80) group by doc_id, f having count(*) > 1""",
    "secret_redact": r"""select doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(t, 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'),
        'access_token=[^&\s]+', 'access_token=[redacted]', 'g'),
        '(?i)(api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|authorization|bot[_-]?token)([''"]?\s*[:=]\s*[''"]?)[^,''"\s}]+', '\1\2[redacted]', 'g')) as redacted
        from (select doc_id, trim(regexp_replace(replace(text, 'token = ', 'access_token: '), '\s+', ' ', 'g')) t from documents)""",
    "failure_fingerprint": """select substr(sha256('error|timeout after <n>s at <url>'), 1, 20) as fingerprint, count(*) n from events where event_type = 'error'""",
    "dates_in_text": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as dates from orders",
    "slugs": r"""select p_partkey, array_to_string(list_slice(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z][a-z0-9]*'), 1, 8), '-') as slug from part""",
    "language_mix": r"""select doc_id, case when l = 0 then 0 else floor(len(regexp_extract_all(text, '\p{Latin}'))::double / l * 100)::int end as latin_percent
        from (select *, len(regexp_extract_all(text, '\p{L}')) l from documents)""",
    "merge_non_blank": """select c_custkey, case when o_custkey is null or o_orderpriority = '5-LOW' then c_mktsegment else o_orderpriority end as label,
        case when o_custkey is null then 'keep' else 'update' end as merge_state
        from customer left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on c_custkey = o_custkey""",
    "source_anti_join": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "recovery_anti_join": """select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)
        and s_suppkey not in (select c_custkey from customer where c_acctbal < 0)""",
    "post_merge_precedence": """with l as (select user_id, event_type, event_id from events where event_type in ('purchase', 'signup')
        qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1)
        select user_id, coalesce(max(case when event_type = 'purchase' then event_id end), max(event_id)) as event_id, bool_or(event_type = 'purchase') as bought from l group by user_id""",
    "interval_unique_match": """select c.event_id as left_id, min(p.event_id) as right_id from events c join events p on c.user_id = p.user_id and p.event_type = 'purchase'
        and abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 1800000000 where c.event_type = 'click' group by c.event_id having count(*) = 1""",
    "all_failed_sources": """select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) n from events group by 1, 2 having count(*) = count(*) filter (event_type = 'error')""",
    "similar_topic_pairs": f"""with k as (select list_sort(kw) t, min(doc_id) rep from ({_KEYWORDS}) group by 1)
        select a.rep as "left", b.rep as "right", len(list_intersect(a.t, b.t))::int as shared, greatest(len(a.t), len(b.t))::int as larger
        from k a join k b on a.rep < b.rep where len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) >= 0.62
          or (len(list_intersect(a.t, b.t)) > 0 and len(list_filter(list_concat(a.t, b.t), lambda w: starts_with(w, 'cve-'))) > 0)""",
    "related_top3": """with s as (select a.p_partkey part, b.p_partkey related, (case when a.p_type = b.p_type then 8 else 0 end + case when a.p_size = b.p_size then 4 else 0 end
        + case when a.p_name = b.p_name then 2 else 0 end)::int as points from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey)
        select part, related, points, row_number() over (partition by part order by points desc, related)::int as place from s where points > 0
        qualify row_number() over (partition by part order by points desc, related) <= 3""",
    "score_clamped": f"""select o_orderkey, greatest(0, least(100, case when o_orderstatus = 'F' then 25 else 0 end + case when age_days <= 365 then 15 else 0 end
        + case when age_days <= 90 then 10 else 0 end + case when c_mktsegment in ('MACHINERY', 'BUILDING') then 3 else 0 end
        + case when o_orderpriority in ('1-URGENT', '2-HIGH') then 10 else 0 end + case when o_totalprice >= 400000 then 10 else 0 end
        + case when o_orderstatus <> 'P' then 10 else 0 end + case when c_nationkey < 5 then 5 else 0 end + case when c_acctbal > 5000 then 5 else 0 end))::int as score from {_ORDERS}""",
    "gate_reasons": f"""select o_orderkey, concat_ws(',', case when o_orderstatus = 'P' then 'pending' end, case when age_days > 1500 then 'stale' end,
        case when c_acctbal < 0 then 'debt' end, case when o_totalprice < 10000 then 'small' end) as reasons,
        not (o_orderstatus = 'P' or age_days > 1500 or c_acctbal < 0 or o_totalprice < 10000) as passed from {_ORDERS}""",
    "urgency_ladder": f"""select case when o_orderstatus = 'P' then 'normal' when d < 0 then 'expired' when f and d <= 2 then 'critical' when f and p >= 100 and d <= 7 then 'high'
        when f and p >= 20 then 'elevated' else 'normal' end as urgency, count(*) n
        from (select *, age_days - 1000 d, o_orderpriority <> '5-LOW' f, trunc(o_totalprice / 4000) p from {_ORDERS}) group by 1""",
    "intake_buckets": """select case when s >= 8 then 'high' when s >= 5 then 'medium' else 'low' end as bucket, count(*) n, sum(s)::bigint as points
        from (select least(10, case when s_acctbal > 0 then 7 else 2 end + [3, 3, 2, 1, 0][(s_suppkey % 5 + 1)::int]) s from supplier) group by 1""",
    "fair_select_topk": f"""with o as (select * from {_ORDERS}), s as (select c_nationkey, max(o_orderdate) served from o where o_orderstatus = 'F' group by 1)
        select o.c_nationkey, o_orderkey, strftime(served, '%Y-%m-%d') as served from o left join s on o.c_nationkey = s.c_nationkey where o_orderstatus = 'O'
        qualify row_number() over (partition by o.c_nationkey order by o_orderpriority, o_orderdate desc, o_totalprice desc, o_orderkey) = 1""",
    "social_priority": f"""select o_orderkey, o_custkey, points from (select *, ({_DEADLINE} + case o_orderpriority when '1-URGENT' then 8 when '2-HIGH' then 6 else 0 end)::int as points
        from (select *, (age_days - 1200) * 24 h from {_ORDERS})) qualify row_number() over (partition by o_custkey order by points desc, o_orderkey) = 1""",
    "batch_top12": "select o_orderkey, o_orderpriority from orders where o_orderstatus <> 'P' order by o_orderpriority, o_orderdate desc, o_totalprice desc, o_orderkey limit 12",
    "round_robin": """select doc_id, source, turn::int as turn from (select doc_id, source, row_number() over (partition by source order by doc_id) turn from documents) order by turn, source limit 60""",
    "best_confidence_dedup": """select source, quality, arg_max(doc_id, (n_chars, -doc_id)) as doc_id, max(n_chars) as n_chars, min(doc_id) as first_position
        from documents join labels using (doc_id) group by source, quality""",
    "daypart_engagement": """select case when hour(ts) < 8 then 'overnight' when hour(ts) < 12 then 'morning' when hour(ts) < 17 then 'midday' else 'evening' end as daypart,
        count(*) samples, count(distinct ts::date) as days, ((sum(round(value * 100)::bigint) * 20 + count(*) * 100) // (count(*) * 200))::bigint / 10 as mean from events
        where event_type <> 'error' and floor((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 1000000) >= 86400 group by 1 having count(*) >= 3 and count(distinct ts::date) >= 2""",
    "daytype_period": """select case when isodow(ts) < 6 then 'weekday' else 'weekend' end as daytype, case when hour(ts) < 12 then 'morning' when hour(ts) < 17 then 'afternoon' else 'evening' end as period,
        count(*) samples, count(distinct ts::date) as days, ((sum(round(value * 100)::bigint) * 200 + count(*) * 100) // (count(*) * 200))::bigint / 100 as mean, count(*) >= 4 as enough,
        count(*) filter (where count(*) >= 4) over () >= 2 as recommend from events where event_type = 'purchase' group by 1, 2""",
    "blocker_top10": """select label, count(*) n from (select unnest(list_filter([case when l_returnflag = 'R' then 'returned' end, case when l_linestatus = 'O' then 'open' end,
        case when l_discount > 0.08 then 'discounted' end, case when l_quantity > 45 then 'bulk' end, case when l_tax = 0 then 'untaxed' end], lambda x: x is not null)) as label from lineitem)
        group by label order by n desc, label limit 10""",
    "category_zero_fill": "select n_nationkey, n_name, count(c_custkey) n from nation left join customer on n_nationkey = c_nationkey and c_acctbal > 9900 group by all",
    "consensus_value": "select l_orderkey, case when count(distinct round(l_tax * 100)) = 1 then min(round(l_tax * 100))::int else 0 end as consensus from lineitem group by 1",
    "coverage_status": """with l as (select l_suppkey, max(case when l_shipdate >= timestamp '2001-06-01' then 1 else 0 end) recent, count(*) lines from lineitem group by 1),
        n as (select s_nationkey, count(*) enabled, sum(coalesce(recent, 0))::bigint recent, sum(coalesce(lines, 0)) lines from supplier left join l on s_suppkey = l_suppkey group by 1)
        select s_nationkey, enabled, recent, case when recent = 0 then 'stalled_discovery' when recent <= 1 and lines > 0 then 'blocked_publication' else 'ok' end as state from n""",
    "daily_cap_window": "select strftime(ts, '%Y-%m-%d') as day, count(*) n, max(epoch_us(ts)) as last_us, count(*) < 60 as allowed from events where event_type = 'purchase' group by 1",
    "archive_by_month": "select strftime(o_orderdate, '%Y-%m') as month, count(*) n, min(o_orderkey) first_order, count(distinct o_custkey) customers from orders where o_orderstatus = 'F' group by 1",
    "props_json": "select (props::json->>'$.k')::int as k, count(*) n from events group by 1",
    "seen_streak_cut": """with m as (select *, sum((event_type <> 'view')::int) over (partition by user_id order by ts, event_id) g from events),
        s as (select *, sum((event_type = 'view')::int) over (partition by user_id, g order by ts, event_id)::bigint streak from m)
        select user_id, event_id, streak from s qualify coalesce(max(streak) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) < 3""",
    "empty_streak_tail": """with n as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events)
        select user_id, (coalesce(min(case when event_type not in ('error', 'view') then r end), count(*) + 1) - 1)::bigint as streak from n where r <= 20 group by user_id""",
    "clamped_fold": """with d as (select user_id, ts::date as day, count(*) filter (event_type = 'error') f, count(*) filter (event_type = 'view') v from events group by 1, 2),
        x as (select user_id, day, (case when f >= 2 then -3 when f = 1 then -1 when v * 2 >= 5 then 0 else 1 end)::bigint as delta from d)
        select user_id, list_reduce(list_prepend(0::bigint, list(delta order by day)), lambda a, b: least(30, greatest(0, a + b)))::bigint as score, count(*) as steps from x group by user_id""",
    "repeat_backoff": """with m as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) g from events),
        r as (select event_id, row_number() over (partition by user_id, g order by ts, event_id) as nth from m where event_type = 'error')
        select event_id, nth::int as nth, least(1440, 15 * pow(2, least(nth - 1, 7)))::int as minutes from r""",
    "late_data_split": """with e as (select event_type, user_id % 2 = 0 as by_day, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0 as age, date_diff('day', ts::date, date '2024-01-31') * 24 as days,
        case event_type when 'click' then 24 when 'view' then 168 when 'error' then 168 else 720 end as lim from events)
        select event_type, case when by_day then days >= 0 and days < lim else age >= 0 and age <= lim end as fresh, count(*) n from e group by 1, 2""",
    "retention_prune": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5",
    "age_band_sample": """with e as (select *, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0 as age from events),
        b as (select *, case when age between 1 and 8 then 'early' when age between 24 and 48 then 'day' when age between 168 and 216 then 'week' end as band from e)
        select user_id, band, event_id from b where band is not null qualify row_number() over (partition by user_id, band order by age, event_id) = 1""",
    "ingest_stream": "select event_type, count(distinct (user_id, date_trunc('hour', ts))) as n from events group by 1",
    "circuit_stream": """with m as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts desc, event_id desc) g from events),
        t as (select *, row_number() over (partition by user_id order by ts, event_id) nth from m where g = 0),
        c as (select user_id, count(*) failures, max(case when value > 100 then epoch_us(ts) + 3600000000 when nth >= 3 then epoch_us(ts) + 2700000000 end) cooldown_us from t group by 1)
        select e.user_id::varchar as source, coalesce(max(failures), 0)::int as failures, max(cooldown_us) as cooldown_us, max(epoch_us(ts)) as last_us from events e left join c using (user_id) group by 1""",
    "identity_resolution": """with o as (select o_orderkey key, o_custkey || ':' || year(o_orderdate) || ':' || o_orderstatus ik, o_custkey || ':' || o_orderstatus sk, o_orderpriority ref,
          (o_orderkey % 6 // 2) h, o_custkey cust, o_orderdate::date posted, o_orderdate::date + 30 deadline, floor(o_totalprice / 50000)::int pos,
          o_orderstatus || '-' || (o_orderkey % 4 < 2) sig, (o_orderkey % 7)::int st, o_orderkey % 5 <> 0 done from orders),
        a as (select * from o where key % 2 = 1), r as (select * from o where key % 2 = 0),
        m as (select a.key article_id, r.key campaign_id, a, r from a join r on a.ik = r.ik
          union all select a.key, r.key, a, r from a join r on a.sk = r.sk where a.ik not in (select ik from r)),
        e as (select *, least(a.st, r.st) >= 4 as strong, a.pos <> r.pos or a.deadline <> r.deadline or (a.h, a.cust) <> (r.h, r.cust) or (a.done and least(a.st, r.st) >= 4 and a.sig <> r.sig) as changed,
          date_diff('day', r.posted, a.posted) as apart from m),
        w as (select *, case when not a.done then 'pending' when strong and a.sig = r.sig then 'same' when strong then 'different' else 'unknown' end as rel,
          (a.deadline = r.deadline)::int + (a.pos > 0 and a.pos = r.pos)::int + (abs(apart) <= 3)::int + 4 * (a.h = r.h)::int as weight from e),
        x as (select *, a.done and (rel = 'same' or (rel <> 'different' and weight >= 6)) as one from w),
        d as (select article_id, campaign_id, case when date_diff('day', r.deadline, a.posted) >= 90 or apart >= 330 then 'new_campaign'
          when a.ref = r.ref or (a.h, a.cust) = (r.h, r.cust) then case when not a.done then 'hold' when changed then 'update' else 'duplicate' end
          when a.sk <> r.sk then 'new' when one then 'duplicate' else 'new_campaign' end as action from x),
        p as (select *, list_position(['update', 'duplicate', 'hold', 'new_campaign', 'new'], action) rank from d),
        b as (select * from p qualify row_number() over (partition by article_id order by rank, campaign_id) = 1)
        select a.key as article_id, coalesce(action, 'new') as action, case when action <> 'new' then campaign_id end as campaign_id from a left join b on a.key = b.article_id""",
    "posting_documents": """select p_partkey, sha1('{"@context":"https://schema.org","@type":"JobPosting","title":"' || p_name || '"'
        || case when p_partkey % 7 = 0 then '' else ',"hiringOrganization":{"@type":"Organization","name":"' || p_brand || '"}' end || ',"datePosted":"2024-01-01","validThrough":"'
        || case when p_size > 25 then '2024-03-01' else '2024-01-15' end || '"'
        || case when p_size > 40 then '' else ',"jobLocation":{"@type":"Place","address":{"@type":"PostalAddress","addressLocality":"' || p_type || '"}}' end || '}') as document,
        concat_ws(',', case when p_partkey % 7 = 0 then 'missing_company' end, case when p_size <= 25 then 'expired' end, case when p_size > 40 then 'missing_location' end) as errors from part""",
    "reply_repair": """select event_id, case when event_id % 3 < 2 then (props::json->>'$.k')::int end as k, case when event_id % 3 < 2 then '' else 'k' end as missing from events""",
    "line_facts": """select s_suppkey, case when s_suppkey % 2 = 0 then 'positions=' || floor(s_acctbal)::bigint else '' end as blocking,
        case when s_suppkey % 2 = 0 then '' else 'location=Rabat ' || s_nationkey end as warnings from supplier""",
    "semantic_index": """with e as (select o_custkey k, list(o_orderkey order by o_orderkey) ids from orders where o_orderkey % 2 = 0 group by 1),
        m as (select o_custkey k, max(o_orderkey) one from orders where o_orderkey % 2 = 1 group by 1)
        select coalesce(e.k, m.k) as k, array_to_string(list_slice(case when one is null then ids else list_append(coalesce(ids, []), one) end, -3, -1), ' ') as ids from e full join m on e.k = m.k""",
    "budgeted_rows": "select conv_id, turn from conversations qualify sum(length(text)) over (partition by conv_id order by turn, role, text rows unbounded preceding) <= 1000",
    "log_tail": "select event_id from events order by ts desc, event_id desc limit 672",
    "weekly_slots": """with s as (select ((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts)) // 50 as slot, count(*) n from events where event_type = 'purchase' group by 1)
        select slot::int as slot, n, coalesce(lead(slot) over (order by slot), min(slot) over ())::int as next_slot from s""",
    "link_degree_orphans": f"""with p as (select {_HOST} as src from pages), e as (select distinct src, regexp_replace(src, '^(?:m|blog)\\.', '') as dst from p), n as (select src as host from e union select dst from e)
        select host, count(*) filter (where dst = host) as in_degree, count(*) filter (where src = host) as out_degree, count(*) filter (where dst = host) = 0 as orphan
        from n left join (select * from e where src <> dst) on host in (src, dst) group by host""",
}
