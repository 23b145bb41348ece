"""The memory of published campaigns: four tables that change together (``sources.commits`` writes them as one commit).

``campaigns`` (campaign_id, identity_key, semantic_key, post_id, updated_at and further columns), ``identity`` (identity_key,
campaign_id), ``semantic`` (semantic_key, campaign_ids: the last ``MOST``), ``counters`` (day, published).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

# Ids of a semantic key that are kept, days of retention, the fewest of them.
MOST = 20
RETENTION, LEAST = 730, 365


def recorded(rows: DataFrame, memory: dict[str, DataFrame], sticky: list[str], day: Column) -> dict[str, DataFrame]:
    """The memory with published ``rows`` (campaign_id, identity_key, semantic_key, action, post_id, updated_at, further columns), of one row for each identity.

    A row takes its campaign's place.  ``sticky`` columns that it leaves blank keep what the identity's campaign had before.  Its identity points to
    it, its semantic key lists it last unless it is listed already.  New campaigns count for the day, unless the identity has the post already.
    """
    campaigns, identity, semantic = memory["campaigns"], memory["identity"], memory["semantic"]
    rows = rows.filter(F.col("action").isin("new", "new_campaign", "update"))
    had = identity.join(campaigns.select("campaign_id", F.col("post_id").alias("_post"), *(F.col(c).alias(f"_{c}") for c in sticky)), "campaign_id").drop("campaign_id")
    met = rows.join(had, "identity_key", "left")
    again = F.coalesce((F.trim("post_id") != "") & (F.col("post_id") == F.col("_post")), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    filled = [F.when(blank(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in sticky else F.col(c) for c in campaigns.columns]
    counted = met.filter((F.col("action") != "update") & ~again).groupBy(day.alias("day")).agg(F.count("*").alias("published"))
    listed = semantic.select("semantic_key", F.posexplode("campaign_ids").alias("at", "campaign_id")).withColumn("tie", F.lit(""))
    fresh = rows.select("semantic_key", "campaign_id").distinct().join(listed.select("semantic_key", "campaign_id"), ["semantic_key", "campaign_id"], "left_anti")
    every = listed.unionByName(fresh.select("semantic_key", F.lit(2**31 - 1).alias("at"), "campaign_id", F.col("campaign_id").alias("tie")))
    last = tables.top_k(every, ["semantic_key"], MOST, F.desc("at"), F.desc("tie"))  # before they are gathered
    ordered = F.array_sort(F.collect_list(F.struct("at", "tie", "campaign_id")))
    return {
        "campaigns": campaigns.join(rows.select("campaign_id"), "campaign_id", "left_anti").select(campaigns.columns).unionByName(met.select(filled)),
        "identity": identity.join(rows.select("identity_key"), "identity_key", "left_anti").select("identity_key", "campaign_id").unionByName(rows.select("identity_key", "campaign_id")),
        "semantic": last.groupBy("semantic_key").agg(F.transform(ordered, lambda x: x["campaign_id"]).alias("campaign_ids")),
        "counters": memory["counters"].unionByName(counted).groupBy("day").agg(F.sum("published").cast("long").alias("published")),
    }


def retained(memory: dict[str, DataFrame], now: Column, days: int = RETENTION) -> tuple[dict[str, DataFrame], DataFrame]:
    """The memory without campaigns last changed more than ``days`` ago (a year at least), and how many rows of each kind went.

    Campaigns without a time stay.  Identities that point to one that went go; its id goes from every list of the semantic index, and lists left empty go.
    """
    campaigns, identity, semantic = memory["campaigns"], memory["identity"], memory["semantic"]
    cutoff = now - F.make_interval(days=F.lit(max(LEAST, days)))
    old = F.coalesce(F.col("updated_at") < cutoff, F.lit(False))
    evicted = campaigns.filter(old).select("campaign_id")
    ids = semantic.select("semantic_key", F.posexplode("campaign_ids").alias("at", "campaign_id"))
    left = ids.join(evicted, "campaign_id", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("at", "campaign_id")))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    went = count(evicted, "campaigns").unionByName(count(identity.join(evicted, "campaign_id", "left_semi"), "identity")).unionByName(count(ids.join(evicted, "campaign_id", "left_semi"), "semantic"))
    kept = {
        "campaigns": campaigns.filter(~old),
        "identity": identity.join(evicted, "campaign_id", "left_anti").select("identity_key", "campaign_id"),
        "semantic": left.groupBy("semantic_key").agg(F.transform(ordered, lambda x: x["campaign_id"]).alias("campaign_ids")),
    }
    return kept, went
