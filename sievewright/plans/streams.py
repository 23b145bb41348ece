"""Streaming queries over the ``events`` table; each drives its stream to the end and reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs, timers
from .catalogue import query, table


@query
def ingest_stream(spark, sf_dir):
    """Events of each user and kind once an hour, by an incremental ingest with a seen-memory."""
    path = f"{sf_dir}/events.parquet"
    events = jobs.read_files(spark, path, table(spark, sf_dir, "events").schema)
    at = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    keyed = events.select("user_id", "event_type", at.alias("hour"), F.col("ts").cast("timestamp").alias("at"))
    out = jobs.scratch(spark, "ingest")
    jobs.run(jobs.ingest(keyed, ["user_id", "event_type", "hour"], "at", "90 minutes"), jobs.append_to(f"{out}/rows"), f"{out}/log")
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query
def circuit_stream(spark, sf_dir):
    """Health of each user's source after all its outcomes."""
    path = f"{sf_dir}/events.parquet"
    events = jobs.read_files(spark, path, table(spark, sf_dir, "events").schema)
    outcome = F.when(F.col("event_type") != "error", "success").when(F.col("value") > 100, "429").otherwise("failure")
    outcomes = events.select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), outcome.alias("outcome"))
    out = jobs.scratch(spark, "health")
    jobs.run(jobs.source_health(outcomes), jobs.append_to(f"{out}/rows"), f"{out}/log", "update")
    states = spark.read.parquet(f"{out}/rows")
    return states.groupBy("source").agg(F.max_by(F.struct("failures", "cooldown_until", "last_seen"), "batch").alias("s")).select(
        "source", "s.failures", F.unix_micros("s.cooldown_until").alias("cooldown_us"), F.unix_micros("s.last_seen").alias("last_us")
    )


@query
def reread_timers(spark, sf_dir):
    """Re-reads of each user's items that timers have let fall due: 20 minutes, 6 hours and 24 hours after the event that opened them."""
    events = jobs.read_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    out = jobs.scratch(spark, "rereads")
    due = timers.rereads(events.select("user_id", F.col("ts").cast("timestamp").alias("at")), "user_id", "at", "1 hour")
    jobs.run(due, jobs.append_to(f"{out}/rows"), f"{out}/log")
    return spark.read.schema(timers.REREAD).parquet(f"{out}/rows").drop("batch")


@query
def circuit_timers(spark, sf_dir):
    """Circuits of each user's source: opened by failures, by the host's class, closed by successes and timers."""
    events = jobs.read_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    failure = F.get(F.array(*map(F.lit, ("timeout", "429", "403", "other"))), (F.col("event_id") % 4).cast("int"))
    outcome = F.when(F.col("event_type").isin("error", "click"), failure).otherwise("success")
    host = F.get(F.array(*map(F.lit, ("slow", "public", "x"))), (F.col("user_id") % 3).cast("int"))
    outcomes = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome"))
    out = jobs.scratch(spark, "circuits")
    jobs.run(timers.circuits(outcomes, "user_id", "at", "event_id", "outcome", host, "1 hour"), jobs.append_to(f"{out}/rows"), f"{out}/log")
    return spark.read.schema(timers.CIRCUIT).parquet(f"{out}/rows").drop("batch")
