"""Structured Streaming jobs: incremental ingest, late data, keyed state machines.

Each runs over what is available and stops, so a schedule can start it again from its
checkpoint.  Time is event time throughout.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Minutes of cool-down after a failure of a kind, and after three in a row.
COOLDOWN = {"429": 60, "403": 180, "timeout": 30}
AFTER_THREE = 45

HEALTH = "source string, failures int, cooldown_until timestamp, last_seen timestamp"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one that the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sievewright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, schema: Any, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream of the Parquet files at ``path``, which may be a single file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark: a durable seen-memory with its own retention."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def split_late(events: DataFrame, time: str, limit_hours: Any, now: Any) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and late rows for a side output."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(time).cast("timestamp"))) / 3_600_000_000
    in_time = F.coalesce((age >= 0) & (age <= limit_hours), F.lit(False))
    return events.filter(in_time), events.filter(~in_time)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is available, batch by batch, and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def health_step(failures: int, cooldown: pd.Timestamp | None, at: pd.Timestamp, outcome: str) -> tuple[int, pd.Timestamp | None]:
    """One outcome of a source: success resets; some failures and every third in a row open a cool-down."""
    if outcome == "success":
        return 0, None
    failures += 1
    minutes = COOLDOWN.get(outcome, AFTER_THREE if failures >= 3 else 0)
    until = at + pd.Timedelta(minutes=minutes) if minutes else None
    return failures, max(filter(None, (cooldown, until)), default=None)


def _health(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, cooldown = (state.get[0], pd.Timestamp(state.get[1], unit="us") if state.get[1] else None) if state.exists else (0, None)
    rows = pd.concat(list(frames)).sort_values(["at", "n"], kind="stable")
    for at, outcome in zip(rows["at"], rows["outcome"], strict=True):
        failures, cooldown = health_step(failures, cooldown, at, outcome)
    state.update((failures, int(cooldown.value // 1000) if cooldown is not None else None))
    yield pd.DataFrame({"source": [key[0]], "failures": [failures], "cooldown_until": [cooldown], "last_seen": [rows["at"].iloc[-1]]})


def source_health(outcomes: DataFrame) -> DataFrame:
    """Health of each source of the stream ``(source, at, n, outcome)``, updated batch by batch."""
    return outcomes.groupBy("source").applyInPandasWithState(_health, HEALTH, "failures int, cooldown bigint", "update", GroupStateTimeout.NoTimeout)


def global_circuit(providers: DataFrame, now: Any) -> DataFrame:
    """``(open, until)`` of ``providers (provider, until)``: open while every provider's circuit is, until the earliest closes."""
    still = F.coalesce(F.col("until") > now, F.lit(False))
    all_open = F.coalesce(F.bool_and(still), F.lit(False))
    return providers.agg(all_open.alias("open"), F.when(all_open, F.min("until")).alias("until"))


def reset(state: DataFrame, lost: Any, columns: list[str]) -> DataFrame:
    """A state table with the cursors of the rows whose queue was lost set back."""
    kept = lambda c: F.when(~F.coalesce(lost, F.lit(False)), F.col(c)).alias(c)
    return state.select(*(kept(c) if c in columns else F.col(c) for c in state.columns))
