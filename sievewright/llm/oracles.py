"""DuckDB SQL of the queries that compare words of whole texts, by plain joins.

CRC-32 is spelt out: ``crc_table`` has its 256 remainders, ``crc(s)`` goes byte by byte.
"""

from __future__ import annotations

_CRC = """
    crc_bits(i, k, c) as (
        select i, 0, i from (select unnest(range(256))::bigint as i)
        union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_bits where k < 8),
    crc_table as (select list(c order by i) as t from crc_bits where k = 8)"""


def _crc(value: str) -> str:
    """The unsigned CRC-32 of a string expression, where ``crc_table`` is joined as ``t``."""
    data = f"list_transform(range(1, strlen({value}) + 1), lambda k: ('0x' || hex(encode({value}))[2 * k - 1:2 * k])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda c, b: xor(c >> 8, t.t[xor(c & 255, b) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_VARIANTS = rf"""with recursive {_CRC},
    runs as (
        select doc_id, run, count(*) as n
        from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents)
        group by all),
    marked as (select run, n, {_crc("(doc_id || ':' || run)")} as h from runs, crc_table t),
    spelt as (select case when h % 199 = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word, n from marked),
    words as (select word, sum(n)::bigint as n from spelt group by word having length(word) >= 6 and sum(n) >= 5),
    less as (select word, n, pos, substring(word, 1, pos) || substring(word, pos + 2) as rest from (select word, n, unnest(range(length(word))) as pos from words)),
    pairs as (
        select a.word, b.word as other, b.n from less a join less b on a.pos = b.pos and a.rest = b.rest and a.word <> b.word
        union select a.word, b.word, b.n from less a join words b on a.rest = b.word
        union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
    best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as other_n from pairs group by word),
    forms as (
        select w.word, case when other_n >= 5 * w.n then other end as form, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other_n end as form_n
        from words w left join best using (word)),
    chains(word, root) as (select word, word from forms union all select c.word, f.form from chains c join forms f on c.root = f.word where f.form is not null)
    select f.word, f.form, c.root, f.n, f.n_near, f.form_n
    from forms f join chains c using (word) join forms e on c.root = e.word where e.form is null"""

_REPEATS = f"""with texts as (select doc_id, {_WORDS} as ws from documents),
    windows as (select doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) as k from (select doc_id, ws, unnest(range(len(ws) - 49)) as i from texts where len(ws) >= 50)),
    earliest as (select k, min(doc_id) as first_doc from windows group by k),
    hits as (select doc_id, i from windows join earliest using (k) where doc_id > first_doc),
    words as (select doc_id, unnest(range(len(ws))) as j, unnest(ws) as word from texts),
    judged as (select w.doc_id, j, word, coalesce(j - h.i < 50, false) as gone from words w asof left join hits h on w.doc_id = h.doc_id and w.j >= h.i),
    edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by j), false) as opens from judged)
    select t.doc_id, count(j) as n_words, count(*) filter (where gone) as n_removed,
        sha256(coalesce(string_agg(word, ' ' order by j) filter (where not gone), '')) as kept_sha256, count(*) filter (where opens) as n_stretches
    from texts t left join edges using (doc_id) group by t.doc_id"""

_PERIODS = f"""with recursive {_CRC},
    texts as (select doc_id, ws, len(ws) as n, h, h // 10 as g from (select doc_id, {_WORDS} as ws, {_crc("doc_id::varchar")} as h from documents, crc_table t)),
    plan as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from texts),
    words as (select doc_id, n, i, ws[case when i < a then i else a + (i - a) % p end + 1] as word from (select *, unnest(range(n)) as i from plan)),
    same as (select x.doc_id, x.i, y.i - x.i as p from words x join words y on x.doc_id = y.doc_id and x.word = y.word and x.i < y.i and 2 * (y.i - x.i) <= x.n),
    islands as (select doc_id, p, min(i) as s, count(*) + p as len from (select *, i - row_number() over (partition by doc_id, p order by i) as grp from same) group by doc_id, p, grp),
    runs as (select doc_id, s, len, min(p) as p from islands where len >= greatest(12, 2 * p) group by doc_id, s, len),
    dropped as (select distinct doc_id, unnest(range(s + p, s + len)) as i from runs),
    kept as (select doc_id, string_agg(word, ' ' order by i) as kept from words anti join dropped using (doc_id, i) group by doc_id),
    longest as (select doc_id, count(*) as n_runs, arg_min(struct_pack(s, len, p), (-len, s, p)) as r, string_agg(s || ',' || len || ',' || p || chr(10), '' order by s, p) as lines from runs group by doc_id)
    select doc_id, coalesce(n_runs, 0) as n_runs, r.s as start, r.len as length, r.p as period, 1000 * r.len // r.p as exponent_milli,
        sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
    from texts left join longest using (doc_id) left join kept using (doc_id)"""

SQL = {"op11_variants": _VARIANTS, "op12_repeats": _REPEATS, "op13_periods": _PERIODS}
