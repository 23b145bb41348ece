"""Places of regular-expression matches in texts, with DataFrame functions alone.

Patterns are Java's.  Write quantifiers that cannot give back as possessive, so that
matching needs neither a deep stack nor more than one look at each character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind: string, start: int, stop: int>>"
_MATCHES = "array<struct<start: int, stop: int, match: string>>"
#: Matches gathered before they join the others, so that gathering stays cheap in long texts.
_BLOCK = 256


def matches(text: Column, pattern: str, around: bool = False) -> Column:
    """All leftmost non-overlapping matches ``(start, stop, match)``, in code points.

    With ``around`` also ``before`` and ``after``: what stands between a match and the one before or after it.
    """
    gaps = F.split(text, pattern, -1)  # one more than matches
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = [gaps.alias("gap"), got.alias("match")]
    kind = _MATCHES
    if around:
        zipped.append(F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
        kind = kind.replace("match: string", "match: string, before: string, after: string")
    pieces = F.filter(F.arrays_zip(*zipped), lambda p: p["match"].isNotNull())
    none = F.array().cast(kind)

    def add(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.char_length(piece["gap"])
        stop = start + F.char_length(piece["match"])
        fields = [start.cast("int").alias("start"), stop.cast("int").alias("stop"), piece["match"].alias("match")]
        if around:
            fields += [piece["gap"].alias("before"), piece["after"].alias("after")]
        block = F.concat(acc["block"], F.array(F.struct(*fields)))
        full = F.size(acc["block"]) >= _BLOCK - 1
        return F.struct(
            stop.cast("int").alias("at"),
            F.when(full, F.concat(acc["done"], F.array(block))).otherwise(acc["done"]).alias("done"),
            F.when(full, none).otherwise(block).alias("block"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("done"), none.alias("block"))
    every = F.aggregate(pieces, start, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))
    return F.when(text.rlike(pattern), every).otherwise(none)


def spans(found: Column, kind: str) -> Column:
    """Matches as spans of a kind."""
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def joined(found: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
