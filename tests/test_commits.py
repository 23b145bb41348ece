"""Commits of several tables, the memory's corner cases, and timers over batches of any cut."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievewright.operators import memory
from sievewright.sources.commits import Conflict, Store
from sievewright.streaming import jobs, timers

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.versions() == [] and store.tables() == {}
    store.commit({"a": spark.range(3), "b": spark.range(1)})
    a, boom = store.read("a"), spark.range(3).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):  # the first table is written, the second is not
        store.commit({"a": spark.range(9), "b": boom})
    assert store.versions() == [0] and ids(store.read("a")) == [0, 1, 2] and ids(store.read("b")) == [0]
    assert store.commit({"b": store.read("a").unionAll(store.read("b"))}) == 1  # reads what it replaces
    assert ids(store.read("b")) == [0, 0, 1, 2] and ids(store.read("b", 0)) == [0] and ids(a) == [0, 1, 2]


def test_of_two_writers_one_fails(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    store.commit({"a": spark.range(1)})
    store.commit({"a": spark.range(2)}, base=0)
    with pytest.raises(Conflict):
        other.commit({"a": spark.range(5)}, base=0)
    assert ids(other.read("a")) == [0, 1]
    other.commit({"a": spark.range(5)})
    assert store.versions() == [0, 1, 2] and len(ids(store.read("a"))) == 5


def test_vacuum_drops_what_no_kept_commit_names(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"a": spark.range(1), "b": spark.range(2)})
    store.commit({"a": spark.range(3)})
    store.write("a", spark.range(7))  # of a run that was lost
    assert store.vacuum(1) == 2 and store.versions() == [1]
    assert ids(store.read("a")) == [0, 1, 2] and ids(store.read("b")) == [0, 1]


def empty_memory(spark):
    make = lambda schema: spark.createDataFrame([], schema)
    return {"campaigns": make("campaign_id string, identity_key string, semantic_key string, post_id string, image string, updated_at timestamp"), "identity": make("identity_key string, campaign_id string"), "semantic": make("semantic_key string, campaign_ids array<string>"), "counters": make("day string, published bigint")}


ROW = "campaign_id string, identity_key string, semantic_key string, post_id string, image string, updated_at timestamp, action string"


def test_memory_keeps_twenty_ids_and_what_a_row_leaves_blank(spark):
    import datetime as dt

    at = dt.datetime(2026, 1, 2)
    many = spark.createDataFrame([(f"c{i:02d}", f"i{i}", "s", f"p{i}", "old", at, "new") for i in range(25)], ROW)
    now = memory.recorded(many, empty_memory(spark), ["image"], F.lit("2026-01-02"))
    assert [r.campaign_ids for r in now["semantic"].collect()] == [[f"c{i:02d}" for i in range(5, 25)]]
    more = spark.createDataFrame([("c24", "i24", "s", "p24", None, at, "new"), ("d", "i3", "s", "q", "", at, "new_campaign"), ("e", "i99", "t", None, "", at, "skip")], ROW)
    now = memory.recorded(more, {k: v.cache() for k, v in now.items()}, ["image"], F.lit("2026-01-03"))
    assert [r.campaign_ids[-2:] for r in now["semantic"].collect()] == [["c24", "d"]]
    assert {r.campaign_id: r.image for r in now["campaigns"].filter("campaign_id in ('c24', 'd')").collect()} == {"c24": "old", "d": "old"}
    assert {r.day: r.published for r in now["counters"].collect()} == {"2026-01-02": 25, "2026-01-03": 1}  # c24 has its post already
    kept, went = memory.retained(now, F.lit("2026-12-30").cast("timestamp"), days=30)  # a year at least
    assert went.agg(F.sum("n")).first()[0] == 0 and kept["campaigns"].count() == 26
    kept, went = memory.retained(now, F.lit("2028-01-03").cast("timestamp"))
    assert {r.kind: r.n for r in went.collect()} == {"campaigns": 26, "identity": 25, "semantic": 20} and kept["semantic"].count() == 0


def cut_up(spark, tmp_path, name, parts):
    path = f"{tmp_path}/{name}"
    ordered = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.ntile(parts).over(__import__("pyspark").sql.Window.orderBy("ts")))
    for i in range(1, parts + 1):
        ordered.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ordered.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def test_timers_do_not_depend_on_batches(spark, tmp_path):
    got = {}
    for parts in (1, 3):
        events = cut_up(spark, tmp_path, f"events-{parts}", parts)
        failed = F.when(F.col("event_type").isin("error", "click"), F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("429")).otherwise("success")
        rows = timers.circuits(events.withColumn("outcome", failed), "user_id", "at", "event_id", "outcome", F.lit("public"), "1 hour")
        jobs.run(rows, jobs.append_to(f"{tmp_path}/circuits-{parts}"), f"{tmp_path}/circuit-log-{parts}")
        due = timers.rereads(events, "user_id", "at", "1 hour")
        jobs.run(due, jobs.append_to(f"{tmp_path}/due-{parts}"), f"{tmp_path}/due-log-{parts}")
        read = lambda n, s: sorted(map(tuple, spark.read.schema(s).parquet(f"{tmp_path}/{n}-{parts}").drop("batch").collect()))  # noqa: B023, E731
        got[parts] = read("circuits", timers.CIRCUIT), read("due", timers.REREAD)
    assert got[1] == got[3] and all(map(len, got[1]))


class Held:
    """What a processor asks of Spark, counted."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getExpiryTimeInMs(self):
        return self.timers[-1]

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_one_timer_gives_all_that_is_due_of_a_key():
    day, minute = 86_400_000_000, 60_000_000
    held, processor = Held(), timers.Rereads((20, 1_440))
    processor.init(held)
    list(processor.handleInputRows(("k",), iter([pd.DataFrame({"us": [i * day + 500 for i in range(5)]})]), held))
    assert held.timers == [20 * 60_000 + 1]
    held.watermark = 2 * 86_400_000 + 20 * 60_000
    (got,) = processor.handleExpiredTimer(("k",), held, held)
    assert list(got["due_us"]) == [500 + 20 * minute, 500 + day, 500 + day + 20 * minute, 500 + 2 * day]
    assert held.timers[1:] == [2 * 86_400_000 + 20 * 60_000 + 1]
    held.watermark = 9 * 86_400_000
    (rest,) = processor.handleExpiredTimer(("k",), held, held)
    assert len(got) + len(rest) == 10 and held.value is None and len(held.timers) == 2


def test_cooldown_by_outcome_and_host():
    assert [timers.cooldown("timeout", "slow", n) for n in (1, 2, 5)] == [5, 15, 30]
    assert [timers.cooldown("timeout", "public", n) for n in (1, 4, 9)] == [5, 10, 15]
    assert [timers.cooldown("timeout", "else", n) for n in (1, 9)] == [30, 30]
    assert [timers.cooldown("other", "", n) for n in (2, 3)] == [0, 45]
    assert timers.circuit_step(0, 100, 50, "success", "") == (0, 0, [("closed", 50, 100, 0)])
    assert timers.circuit_step(2, 100, 150, "other", "")[2][0] == ("closed", 100, 100, 2)
