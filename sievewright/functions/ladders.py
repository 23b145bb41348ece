"""Scores, gates and case ladders over named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(*rules: tuple[Column, str], otherwise: str = "") -> Column:
    """The label of the first rule that holds."""
    out = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return out.otherwise(F.lit(otherwise))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The labels of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(label)) for condition, label in rules)))


def points(*weights: tuple[Column, float], low: float = 0, high: float = 100) -> Column:
    """The sum of the weights that hold, within bounds."""
    total = reduce(lambda a, b: a + b, (F.when(condition, F.lit(w)).otherwise(F.lit(0)) for condition, w in weights))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


# Weights of the selection score.
SCORE = {
    "official": 25, "fresh": 15, "very_fresh": 10, "focus": 3, "priority": 10, "many_positions": 10,
    "deadline": 10, "location": 5, "diploma": 5, "application": 10, "salary": 5, "entry_level": 5,
}


def score(indicators: dict[str, Column]) -> Column:
    """The selection score of the indicators that are given."""
    return points(*((condition, SCORE[name]) for name, condition in indicators.items()))


def urgency(notice: Column, official: Column, days: Column, positions: Column) -> Column:
    return first_of(
        (~notice.isin("vacancy", "competition"), "normal"),
        (days < 0, "expired"),
        (official & (days <= 2), "critical"),
        (official & (positions >= 100) & (days.isNull() | (days <= 7)), "high"),
        (official & (positions >= 20), "elevated"),
        otherwise="normal",
    )


def deadline_points(hours: Column) -> Column:
    """Points for how near a deadline is."""
    ladder = F.when(hours <= 24, 30).when(hours <= 48, 26).when(hours <= 72, 22).when(hours <= 168, 16).when(hours <= 336, 10)
    return F.when(hours.isNull(), 0).otherwise(ladder.otherwise(4))


def intake_score(official: Column, priority: Column) -> Column:
    bonus = F.coalesce(F.create_map(*map(F.lit, ("s+", 3, "s", 3, "a+", 2, "a", 1)))[F.lower(priority)], F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(10), F.when(official, 7).otherwise(2) + bonus))


def intake_bucket(score_: Column) -> Column:
    return first_of((score_ >= 8, "high"), (score_ >= 5, "medium"), otherwise="low")


def day_health(rate_limits: Column, failures: Column, soft_failures: Column, warnings: Column, fallbacks: Column, successes: Column) -> Column:
    """``(state, delta)`` of a day's counters."""
    rules = [
        (rate_limits > 0, "red", -4),
        (failures >= 2, "red", -3),
        (failures == 1, "yellow", -1),
        ((soft_failures > 0) | (warnings >= 5), "yellow", 0),
        (fallbacks >= 2, "yellow", 0),
        (successes > 0, "green", 1),
    ]
    state = first_of(*((c, s) for c, s, _ in rules), otherwise="neutral")
    delta = reduce(lambda acc, r: acc.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise(0)
    return F.struct(state.alias("state"), delta.alias("delta"))


def step(value: Column, thresholds: tuple[float, ...], results: tuple[float, ...]) -> Column:
    """The result of the highest threshold that is reached."""
    out = F.lit(results[0])
    for t, r in zip(thresholds[1:], results[1:], strict=True):
        out = F.when(value >= t, F.lit(r)).otherwise(out)
    return out


def coverage(idle_minutes: Column, publishes: Column, discoveries: Column, empty_streak: Column, enabled: Column, recent: Column) -> Column:
    return first_of(
        ((enabled > 0) & (recent == 0), "stalled_discovery"),
        ((idle_minutes.isNull() | (idle_minutes >= 360)) & (publishes == 0) & (discoveries > 0), "blocked_publication"),
        ((empty_streak >= 3) & (publishes == 0), "starved"),
        otherwise="ok",
    )
