"""Queries of the campaign memory: batches recorded and old campaigns evicted, each as one commit of all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory
from ..sources.commits import Store
from ..streaming import jobs
from .catalogue import query, table
from .gate_queries import oracle

_CAMPAIGN = "campaign_id string, identity_key string, semantic_key string, post_id string, image string, company string, updated_at timestamp"


def _recorded(spark, sf_dir) -> Store:
    """Orders as publications of two batches: the years before 1998, and from then on."""
    store = Store(spark, jobs.scratch(spark, "memory"))
    none = lambda schema: spark.createDataFrame([], schema)
    store.commit({"campaigns": none(_CAMPAIGN), "identity": none("identity_key string, campaign_id string"), "semantic": none("semantic_key string, campaign_ids array<string>"), "counters": none("day string, published bigint")})
    orders = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    key, twin = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3 == 0
    # of an identity (customer and priority) the last order of a batch is published
    late = F.col("at") >= F.lit("1998-01-01").cast("timestamp")
    identity = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")
    rows = orders.select(
        late.alias("late"), identity.alias("identity_key"), key.alias("campaign_id"), (F.col("o_custkey") % 50).cast("string").alias("semantic_key"), F.when(twin, F.lit("post")).otherwise(key).alias("post_id"),
        F.when(~late, F.concat(F.lit("image-"), key)).otherwise(F.when(F.col("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("new-"), key))).alias("image"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("company"), F.col("at").alias("updated_at"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("update")).otherwise("new").alias("action"),
    )
    rows = rows.groupBy("late", "identity_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("late", "identity_key")]), F.struct("updated_at", F.lpad("campaign_id", 12, "0"))).alias("r")).select("late", "identity_key", "r.*")
    for late_ in (False, True):
        store.commit(memory.recorded(rows.filter(F.col("late") == late_).drop("late"), store.tables(), ["image"], F.date_format("updated_at", "yyyy-MM")))
    return store


_ROWS = """
    o as (select o_orderdate >= timestamp '1998-01-01' as late, o_custkey::varchar || '/' || o_orderpriority as identity_key, o_orderkey as k, (o_custkey % 50)::varchar as semantic_key, o_orderdate as happened, o_orderstatus as s from orders),
    r as (select * from o qualify row_number() over (partition by late, identity_key order by happened desc, k desc) = 1),
    c as (select r.*, case when r.k % 3 = 0 then 'post' else r.k::varchar end as post, p.k as before, case when p.k % 3 = 0 then 'post' else p.k::varchar end as post_before from r left join r p on r.late and not p.late and p.identity_key = r.identity_key),
    listed as (select *, row_number() over (partition by semantic_key order by late desc, k::varchar desc) as back from c),
    held as (select semantic_key, k, late, late as recent from listed where late and back <= 20
        union all select semantic_key, k, late, false from (select *, row_number() over (partition by semantic_key order by k::varchar desc) as own, (select count(*) from c x where x.late and x.semantic_key = c.semantic_key) as newer from c where not late) where own <= 20 and own + newer <= 20)"""


@oracle(f"""with {_ROWS}
    select 'campaigns' as tbl, k::varchar as key, coalesce(case when not late then 'image-' || k when k % 2 = 1 then 'new-' || k else case when before is not null then 'image-' || before else ' ' end end, '') || '|' || coalesce(case when k % 5 > 0 then s end, '') as val from c
    union all select 'identity', identity_key, k::varchar from (select * from c qualify row_number() over (partition by identity_key order by late desc) = 1)
    union all select 'semantic', semantic_key, string_agg(k::varchar, ',' order by recent, k::varchar) from held group by semantic_key
    union all select 'counters', strftime(happened, '%Y-%m'), count(*)::varchar from c where k % 7 > 0 and not coalesce(post = post_before, false) group by all""")
@query
def campaign_memory(spark, sf_dir):
    """The memory after two batches: campaigns with what they keep, pointers, lists and counters."""
    now = _recorded(spark, sf_dir).tables()
    kept = F.concat_ws("|", F.coalesce("image", F.lit(" ")), F.coalesce("company", F.lit("")))
    return (
        now["campaigns"].select(F.lit("campaigns").alias("tbl"), F.col("campaign_id").alias("key"), kept.alias("val"))
        .unionAll(now["identity"].select(F.lit("identity"), "identity_key", "campaign_id"))
        .unionAll(now["semantic"].select(F.lit("semantic"), "semantic_key", F.array_join("campaign_ids", ",")))
        .unionAll(now["counters"].select(F.lit("counters"), "day", F.col("published").cast("string")))
    )


@oracle(f"""with {_ROWS}, gone as (select k from c where happened < timestamp '2001-09-01' - interval 730 day), last as (select * from c qualify row_number() over (partition by identity_key order by late desc) = 1)
    select 'identity' as tbl, identity_key as key, k::varchar as val from last where k not in (select k from gone)
    union all select 'semantic', semantic_key, string_agg(k::varchar, ',' order by recent, k::varchar) from held where k not in (select k from gone) group by semantic_key
    union all select 'campaigns', k::varchar, '' from c where k not in (select k from gone)
    union all select 'went', 'campaigns', count(*)::varchar from gone
    union all select 'went', 'identity', count(*)::varchar from last where k in (select k from gone)
    union all select 'went', 'semantic', count(*)::varchar from held where k in (select k from gone)""")
@query
def retention_cascade(spark, sf_dir):
    """The memory without campaigns of more than 730 days: pointers, lists and keys go with them, in one commit."""
    store = _recorded(spark, sf_dir)
    kept, went = memory.retained(store.tables(), F.lit("2001-09-01").cast("timestamp"))
    store.commit(kept | {"went": went})
    now = store.tables()
    return (
        now["identity"].select(F.lit("identity").alias("tbl"), F.col("identity_key").alias("key"), F.col("campaign_id").alias("val"))
        .unionAll(now["semantic"].select(F.lit("semantic"), "semantic_key", F.array_join("campaign_ids", ",")))
        .unionAll(now["campaigns"].select(F.lit("campaigns"), "campaign_id", F.lit("")))
        .unionAll(now["went"].select(F.lit("went"), "kind", F.col("n").cast("string")))
    )
