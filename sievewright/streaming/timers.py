"""Keyed state with event-time timers: re-reads that fall due, and circuits that close by themselves.

Both process a key's rows in event time and set timers; what a timer emits depends on event times alone, so it is the same however the
rows are cut into batches, as long as they come in order within the watermark's delay.  State is dropped once nothing is pending.
A key's rows of one batch are reduced to arrays of times and codes, frame by frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Minutes after which a followed item is read again.
REREADS = (20, 360, 1_440)
# Minutes of cool-down by outcome; of any failure from the third in a row on; of time-outs by the host's class: at first, from two failures on, from five on.
COOLDOWN = {"429": 60, "403": 180}
AFTER_THREE = 45
TIMEOUTS = {"slow": (5, 15, 30), "public": (5, 10, 15), "": (30, 30, 30)}
REREAD = "key string, opened_us bigint, minutes int, due_us bigint"
CIRCUIT = "source string, kind string, at_us bigint, until_us bigint, failures int"
_MINUTE = 60_000_000


def prepared(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(us: int) -> int:
    """The first whole millisecond at or after a time."""
    return -(-us // 1_000)


def episodes(times: np.ndarray, opened: int | None, length: int) -> list[int]:
    """Times, ascending, that open an item: the first, and each that comes ``length`` or more after the one before."""
    found = []
    at = 0
    while at < len(times):
        if opened is not None and times[at] < opened + length:
            at = int(np.searchsorted(times, opened + length))
            continue
        opened = int(times[at])
        found.append(opened)
    return found


def _texts(values: list[str]) -> pd.Series:
    # plain objects: frames of several chunks of Arrow strings are not taken back
    return pd.Series(values, dtype=object)


def _due(keys: list[str], opened: list[int], minutes: list[int], due: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"key": _texts(keys), "opened_us": opened, "minutes": minutes, "due_us": due})


class Rereads(StatefulProcessor):
    """A key has one timer, of what falls due first: it gives all that is due by then, so calls grow with keys and not with re-reads."""

    def __init__(self, minutes: tuple[int, ...]) -> None:
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what opened the item last, and what is pending: by when it was opened, and minutes
        self.state = handle.getValueState("state", "last bigint, opened array<bigint>, minutes array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([f["us"].to_numpy(np.int64) for f in rows]))
        last, opened, minutes = self.state.get() if self.state.exists() else (None, [], [])
        before = min(map(self._ms, opened, minutes), default=None)
        found = episodes(times, last, max(self.minutes) * _MINUTE)
        if found:
            opened, minutes = [*opened, *(o for o in found for _ in self.minutes)], [*minutes, *(m for _ in found for m in self.minutes)]
            self.state.update((found[-1], opened, minutes))
            if (first := min(map(self._ms, opened, minutes))) != before:
                self.handle.registerTimer(first)
        yield _due([], [], [], [])

    @staticmethod
    def _ms(opened: int, minutes: int) -> int:
        return _millis(opened + minutes * _MINUTE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        last, opened, minutes = self.state.get() if self.state.exists() else (None, [], [])
        pending = list(zip(opened, minutes, strict=True))
        fallen = [p for p in pending if self._ms(*p) <= now]
        left = [p for p in pending if self._ms(*p) > now]
        if left and fallen:
            self.state.update((last, *map(list, zip(*left, strict=True))))
            self.handle.registerTimer(min(self._ms(*p) for p in left))
        elif not left and self.state.exists():
            self.state.clear()
        yield _due([key[0]] * len(fallen), [o for o, _ in fallen], [m for _, m in fallen], [o + m * _MINUTE for o, m in fallen])

    def close(self) -> None:
        pass


def rereads(items: DataFrame, key: str, time: str, delay: str, minutes: tuple[int, ...] = REREADS) -> DataFrame:
    """``(key, opened_us, minutes, due_us)`` as each falls due: items are read again so many minutes after the row that opened
    them; rows of an item that is still followed open nothing."""
    prepared(items.sparkSession)
    keyed = items.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.unix_micros(time).alias("us")).filter("at is not null")
    return keyed.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Rereads(minutes), outputStructType=REREAD, outputMode="append", timeMode="eventTime")


def cooldown(outcome: str, host: str, failures: int) -> int:
    """Minutes of cool-down after the ``failures``-th failure in a row; 0 for none."""
    if outcome == "timeout":
        first, second, third = TIMEOUTS.get(host, TIMEOUTS[""])
        return third if failures >= 5 else second if failures >= 2 else first
    return COOLDOWN.get(outcome, AFTER_THREE if failures >= 3 else 0)


def circuit_step(failures: int, until: int, at: int, outcome: str, host: str) -> tuple[int, int, list[tuple[str, int, int, int]]]:
    """State and rows (kind, at, until, failures) after an outcome; ``until`` is 0 for a closed circuit."""
    rows = []
    if until and at > until:
        rows.append(("closed", until, until, failures))
        until = 0
    if outcome == "success":
        if until:
            rows.append(("closed", at, until, failures))
        return 0, 0, rows
    failures += 1
    if minutes := cooldown(outcome, host, failures):
        until = max(until, at + minutes * _MINUTE)
        rows.append(("open", at, until, failures))
    return failures, until, rows


class Circuits(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures int, until bigint")

    def _rows(self, source: str, rows: list[tuple]) -> pd.DataFrame:
        kinds, at, until, failures = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"source": _texts([source] * len(rows)), "kind": _texts(list(kinds)), "at_us": list(at), "until_us": list(until), "failures": list(failures)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat([f[["us", "n", "outcome", "host"]].astype({"outcome": "category", "host": "category"}) for f in rows]).sort_values(["us", "n"], kind="stable")
        failures, until = self.state.get() if self.state.exists() else (0, 0)
        told: list[tuple] = []
        for us, outcome, host in zip(every["us"].tolist(), every["outcome"], every["host"], strict=True):
            failures, until, more = circuit_step(failures, until, us, outcome, host)
            told += more
        if until:
            self.handle.registerTimer(_millis(until))
        self.state.update((failures, until))
        yield self._rows(key[0], told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, until = self.state.get() if self.state.exists() else (0, 0)
        if not until or _millis(until) != expiredTimerInfo.getExpiryTimeInMs():  # closed or put off since
            yield self._rows(key[0], [])
            return
        self.state.update((failures, 0))
        yield self._rows(key[0], [("closed", until, until, failures)])

    def close(self) -> None:
        pass


def circuits(outcomes: DataFrame, source: str, time: str, tie: str, outcome: str, host: Column, delay: str) -> DataFrame:
    """``(source, kind, at_us, until_us, failures)``: a row when a source's circuit opens or is put off, and one when it closes, by a success or in time.

    ``host`` is the class of the source's host: "slow", "public" or other.
    """
    prepared(outcomes.sparkSession)
    keyed = outcomes.select(F.col(source).cast("string").alias("source"), F.col(time).alias("at"), F.unix_micros(time).alias("us"), F.col(tie).cast("long").alias("n"), F.col(outcome).alias("outcome"), host.alias("host"))
    return keyed.withWatermark("at", delay).groupBy("source").transformWithStateInPandas(Circuits(), outputStructType=CIRCUIT, outputMode="append", timeMode="eventTime")
