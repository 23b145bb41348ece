"""Secret scans through a trigram inverted index.

``query_of`` derives from a rule's regex the Boolean query of trigrams that every
match must contain: literals and small classes spell out the strings that a part
can match, a string's trigrams are ANDed, alternatives ORed, and what
repeats or is too wide ends a string.  ``postings`` builds the index of the rules'
trigrams: a row for each trigram and text that has it.  ``candidates`` intersects the
postings by text and evaluates each rule's query.  ``scan`` verifies each rule's
candidates with the regex itself; a rule without mandatory trigrams scans every text.

Texts are addressed by two 64-bit hashes, so copies share their postings and no
row is lost where ids repeat or are null.  A text's postings are at most the rules' trigrams, and
they alone are shuffled: texts stay where they are read.  The candidates come back to them as a table of bits,
``BUCKETS`` rows of 4,096 bytes whatever the corpus holds, which is broadcast: a text looks up one byte, with a bit for each rule.
Two texts that share a byte share their bits, so a text may be verified in vain, but no candidate is
passed over; the more candidates there are than bytes (16 million), the more texts are verified,
up to all.  Everything is DataFrame functions.

Defined results: a null or empty text has no spans; repeated rows have the same spans;
spans are in code points, the end exclusive, ordered by start, then rule.  An empty table gives no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import absent, need
from .spans import SPAN, matches

#: Strings spelled out at a time, and characters of a class.
STRINGS, CLASS = 12, 3
#: Rows of the table of candidates; bytes of each, which ``bitmap_construct_agg`` fixes.
BUCKETS, BYTES = 4_096, 4_096
#: True, a trigram, or ("and" | "or", queries)
Query = bool | str | tuple[str, tuple]


@dataclass(frozen=True)
class Rule:
    kind: str
    #: a regex in the common syntax of Java and Python
    pattern: str
    #: whether a match is kept, given the match
    keep: Callable[[Column], Column] = lambda m: F.lit(True)


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: The base rules, then further well-known formats.
BASE = (
    Rule("assign", _ASSIGN, lambda m: F.char_length(F.regexp_extract(m, _ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]++", lambda m: F.char_length(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}+"),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("url", r"[a-z]{3,12}+://[A-Za-z0-9._-]{1,64}+:[A-Za-z0-9._-]{3,64}+@"),
)


def _both(queries: list[Query], how: str) -> Query:
    """AND or OR of queries, without what adds nothing."""
    flat: list[Query] = []
    for q in queries:
        flat += q[1] if isinstance(q, tuple) and q[0] == how else [q]
    flat = list(dict.fromkeys(flat))
    if how == "or" and True in flat:
        return True
    flat = [q for q in flat if q is not True]
    return True if not flat else flat[0] if len(flat) == 1 else (how, tuple(flat))


def _spelled(strings: set[str]) -> Query:
    """The query that one of these strings occurs."""
    return _both([_both([s[i : i + 3] for i in range(len(s) - 2)], "and") for s in sorted(strings)], "or")


def _chars(items: list) -> set[str] | None:
    """Lower-cased characters of a small class; None for a wide one."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= CLASS + 2 else None


def _parts(pattern) -> tuple[set[str] | None, Query]:
    """The strings that a parsed pattern matches, if they can be spelled out, and its query."""
    said: list[Query] = []
    now: set[str] | None = {""}  # strings of the part since the last break
    whole = True

    def end() -> None:
        nonlocal now, whole
        said.append(_spelled(now))
        now, whole = {""}, False

    for op, value in pattern:
        strings, query = None, True
        if op is sre.LITERAL:
            strings = {chr(value).lower()}
        elif op is sre.IN:
            strings = _chars(value)
        elif op is sre.SUBPATTERN:
            strings, query = _parts(value[-1])
        elif op is sre.BRANCH:
            parts = [_parts(p) for p in value[1]]
            strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
            query = _both([q for _, q in parts], "or")
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            inner, inner_query = _parts(value[2])
            if value[:2] == (0, 1) and inner is not None:
                strings = inner | {""}
            elif value[0] > 0:
                query = inner_query if inner is None else _both([inner_query, _spelled(inner)], "and")
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if strings is not None and len(now) * len(strings) <= STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        end()
        if strings is not None and len(strings) <= STRINGS:
            now = strings
        elif strings is not None:
            said.append(_spelled(strings))
        else:
            said.append(query)
    if whole:
        return now, _both(said, "and")
    return None, _both([*said, _spelled(now)], "and")


def query_of(pattern: str) -> Query:
    """The Boolean query of lower-cased trigrams that a text with a match satisfies; True if there is none."""
    strings, query = _parts(parser.parse(pattern))
    return query if strings is None else _both([query, _spelled(strings)], "and")


def trigrams_of(query: Query) -> list[str]:
    if isinstance(query, tuple):
        return sorted(set().union(*map(trigrams_of, query[1])))
    return [] if query is True else [query]


def key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")


def postings(df: DataFrame, text: str, trigrams: list[str]) -> DataFrame:
    """``(trigram, k1, k2)``: the number of each of ``trigrams`` and the key of each text that has it."""
    folded = df.filter(F.col(text).isNotNull()).select(*key(F.col(text)), F.lower(text).alias("folded"))
    held = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return folded.select(F.explode(held).alias("trigram"), "k1", "k2").distinct()


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, Query]) -> DataFrame:
    """``(k1, k2, one boolean for each query)`` of the texts that satisfy at least one of ``queries``."""
    at = {t: i for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // 62))
    bit = F.expr("shiftleft(1L, trigram % 62)")
    met = index.groupBy("k1", "k2").agg(*(F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, bit).otherwise(0)).alias(f"_{w}") for w in words))

    def holds(q: Query) -> Column:
        if isinstance(q, tuple):
            return reduce(lambda a, b: (a & b) if q[0] == "and" else (a | b), map(holds, q[1]))
        return F.lit(True) if q is True else F.col(f"_{at[q] // 62}").bitwiseAND(F.lit(1 << at[q] % 62)) != 0

    found = met.select("k1", "k2", *(holds(q).alias(kind) for kind, q in queries.items()))
    return found.filter(reduce(lambda a, b: a | b, map(F.col, queries)))


def table_of(found: DataFrame, kinds: list[str]) -> DataFrame:
    """``(bucket, flags)``: the candidates ``found`` as bits, a byte for each address and a bit for each of at most eight kinds."""
    if len(kinds) > 8:
        raise ValueError("a table holds eight rules")
    at = F.col("k2").bitwiseAND(F.lit(BYTES - 1)) * 8
    bits = F.explode(F.array_compact(F.array(*(F.when(F.col(kind), at + i) for i, kind in enumerate(kinds)))))
    return found.select(F.col("k1").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"), bits.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("flags"))


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None, name: str = "secrets") -> DataFrame:
    """The columns ``keep`` (all by default) and ``name``: the rules' spans in each text."""
    keep = df.columns if keep is None else keep
    need(df, text, *keep)
    absent(df.select(*keep), name)
    queries = {r.kind: q for r in rules if (q := query_of(r.pattern)) is not True}
    own = df.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    kinds = sorted(queries)
    body = F.coalesce("text", F.lit(""))
    # a table of bits for every eight rules
    for n in range(0, len(kinds), 8):
        some = {kind: queries[kind] for kind in kinds[n : n + 8]}
        trigrams = sorted(set().union(*map(trigrams_of, some.values())))
        table = table_of(candidates(postings(df, text, trigrams), trigrams, some), list(some))
        table = table.select(F.col("bucket").alias("_bucket"), F.col("flags").alias("_flags"))
        k1, k2 = key(body)
        own = own.join(F.broadcast(table), k1.bitwiseAND(F.lit(BUCKETS - 1)) == F.col("_bucket"), "left")  # at most BUCKETS rows
        byte = F.substring("_flags", (k2.bitwiseAND(F.lit(BYTES - 1)) + 1).cast("int"), F.lit(1))
        own = own.withColumn(f"_may{n // 8}", F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int"), F.lit(0))).drop("_bucket", "_flags")

    def of(rank: int, rule: Rule) -> Column:
        kept = F.filter(matches(body, rule.pattern), lambda m: rule.keep(m["match"]))
        ranked = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), m["stop"].alias("stop")))
        if rule.kind not in queries:
            return ranked
        n = kinds.index(rule.kind)
        may = F.col(f"_may{n // 8}").bitwiseAND(F.lit(1 << n % 8)) != 0
        return F.when(may, ranked).otherwise(F.array().cast("array<struct<start: int, rank: int, kind: string, stop: int>>"))

    every = F.array_sort(F.concat(*(of(rank, rule) for rank, rule in enumerate(rules))))
    spans = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).cast(SPAN)
    return own.select("row.*", spans.alias(name))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each of its spans replaced; overlapping spans are replaced as one."""

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.when(fresh, F.concat(gap, F.lit(mark))).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(found) == 0, text).otherwise(
        F.aggregate(found, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    )
