"""Running means of candidates: state that batches are merged into without reading history again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

STATE = "candidate string, successes bigint, timed bigint, total decimal(38,4), last_at timestamp"


def summed(calls: DataFrame, candidate: str, seconds: str, at: str) -> DataFrame:
    """The state of one batch of successful calls: numbers, sums of seconds to four places, the last time.  Calls without a time count as successes."""
    exact = F.round(F.col(seconds).cast("decimal(18,6)"), 4).cast("decimal(18,4)")
    return calls.groupBy(F.col(candidate).alias("candidate")).agg(F.count("*").alias("successes"), F.count(exact).alias("timed"), F.coalesce(F.sum(exact), F.lit(0)).cast("decimal(38,4)").alias("total"), F.max(at).alias("last_at"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several: sums of sums, in any order and grouping."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every.groupBy("candidate").agg(F.sum("successes").alias("successes"), F.sum("timed").alias("timed"), F.sum("total").cast("decimal(38,4)").alias("total"), F.max("last_at").alias("last_at"))


def means(state: DataFrame) -> DataFrame:
    """Add ``mean`` seconds (sum over successes, four places) and ``fastest``: the candidate of the least mean, the smaller name of equals."""
    mean = F.when(F.col("timed") > 0, F.round(F.col("total") / F.col("successes"), 4))
    best = state.agg(F.min(F.when(mean.isNotNull(), F.struct(mean.alias("m"), F.col("candidate").alias("c")))).alias("own"))
    return state.crossJoin(F.broadcast(best.select(F.col("own.c").alias("_fastest")))).select("*", mean.alias("mean"), F.coalesce(F.col("candidate") == F.col("_fastest"), F.lit(False)).alias("fastest")).drop("_fastest")  # one row


def preferred(candidates: DataFrame, state: DataFrame, name: str, position: str) -> DataFrame:
    """Candidates in their order, but the remembered fastest first: ``rank`` from 1 within the caller's small list."""
    known = means(state).filter("fastest").select(F.col("candidate").alias(name), F.lit(0).alias("_first"))
    ranked = candidates.join(F.broadcast(known), name, "left").withColumn("_first", F.coalesce("_first", F.lit(1)))  # at most one row
    return tables.top_k(ranked.withColumn("_all", F.lit(0)), ["_all"], 2**31 - 1, "_first", position, name, rank="rank").drop("_all", "_first")
