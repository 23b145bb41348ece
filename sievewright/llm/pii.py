"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

Formats (e-mail, ip, card, phone) are matched in every text.  Their matches seed a
bootstrap over *identifiers*: the matches, and the other tokens that have a digit or an at
sign:

* an identifier occurs in lexical *patterns*, in words whose digits are generalised: the two words before it; the word
  before it with the identifier's *shape* (its runs of letters, and its digits and signs one by one); its
  shape with the word after it; its shape alone.  The spelling and the contexts teach each other;
* the graph of patterns and identifiers (distinct values, so copies count once) is
  scored in ``ROUNDS`` rounds.  Seeds have score 1, ``OTHER`` formats that show no person (years, versions, amounts, times,
  long hexadecimal runs, web addresses) 0; what is neither has none at first.  A pattern's confidence is the mean
  score of its scored identifiers, damped for patterns of few; an identifier's is the noisy-or of its patterns that are confident,
  and with it it enters the next round;
* a pattern is confident with a confidence of at least ``CONFIDENT`` and at least ``SEEDS`` identifiers whose score is
  that high; an unseen identifier of a length in ``LENGTH`` whose score reaches ``CONFIDENT`` is a
  span of kind ``context``.

Identifiers of one shape with many seeds are therefore all found, such as numbers of sixteen digits beside
those that pass the check digit: a scan for personal data prefers a number too many to one too few.

Everything is DataFrame functions.  Texts are read once and never shuffled: what
later steps need of a row is its spans and identifiers, which are written
to the checkpoint folder.  Words around an identifier are whole, whatever their length.  Patterns and identifiers are joined by hash; the
joins are dealt out by salts where a pattern or an identifier holds many rows.

Defined results: a null or empty text has no spans; repeated rows have the same spans;
spans are in code points, the end exclusive, ordered by kind, then start; without
confident patterns only the formats' spans are found; an empty table gives no rows; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, need, spread_join
from .spans import SPAN, matches, spans

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
ROUNDS, CONFIDENT, SEEDS, DAMPING = 3, 0.75, 3, 1.0
#: Characters of an identifier that a context alone can show to be one.
LENGTH = (6, 64)
_SPACE = r"\x20\x09-\x0D"
_LOCAL = "A-Za-z0-9._%+-"
#: Formats; quantifiers that nothing can follow are possessive, and a match can only begin
#: where a run of its first characters begins or where the match before has ended.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that show no person: years, versions, amounts, times, dates, ordinals; long hexadecimal runs; web addresses.
OTHER = r"^(?:[0-9]{1,5}(?:[.,:/-][0-9]{1,4}){0,3}(?:%|[a-z]{1,2})?|v[0-9][0-9.]*|(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}|[a-z]+://.*)$"
#: A token with a digit or an at sign.
IDENTIFIER = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _found(text: Column) -> Column:
    """Matches of the fixed formats with their kinds and what stands around them, ordered by kind, then start."""
    octet = lambda part: (F.char_length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    held = {
        "email": (EMAIL, lambda m: F.lit(True)),
        "ip": (IP, lambda m: F.forall(F.split(m, r"\."), octet)),
        "card": (CARD, lambda m: F.when(F.char_length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))),
        "phone": (PHONE, lambda m: F.char_length(_digits(m)).between(9, 15)),
    }
    of = lambda kind, pattern, keep: F.transform(
        F.filter(matches(text, pattern, around=True), lambda m: keep(m["match"])), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), surrounded(m, True).alias("token"))
    )
    return F.concat(*(of(kind, pattern, keep) for kind, (pattern, keep) in held.items()))


def formats(text: Column) -> Column:
    """Spans of the fixed formats, ordered by kind, then start."""
    return F.transform(_found(text), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def shape(value: Column) -> Column:
    """An identifier's spelling: a run of letters as one ``a``, each digit as ``9``, other characters themselves."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")


def surrounded(m: Column, seed: bool) -> Column:
    """A match as an identifier ``(start, stop, value, shape, before, last, after, known)``; ``known`` is 1 for a seed, 0 for other formats."""
    general = lambda word: F.regexp_replace(F.lower(word), "[0-9]", "9")
    back = F.reverse(m["before"])  # so that the last words are at its start
    word = rf"([^{_SPACE}]+)"
    before = lambda i: general(F.reverse(F.regexp_extract(back, rf"^[{_SPACE}]*{word}(?:[{_SPACE}]+{word})?", i)))
    bare = F.regexp_replace(m["match"], r"^[^A-Za-z0-9@+]+|[^A-Za-z0-9]+$", "")
    lead = F.char_length(F.regexp_extract(m["match"], r"^[^A-Za-z0-9@+]*", 0))
    folded = F.lower(bare)
    return F.struct(
        (m["start"] + lead).alias("start"),
        (m["start"] + lead + F.char_length(bare)).alias("stop"),
        F.xxhash64(folded).alias("value"),
        F.xxhash64(shape(bare)).alias("shape"),
        before(2).alias("before"),
        before(1).alias("last"),
        general(F.regexp_extract(m["after"], rf"^[^{_SPACE}]*[{_SPACE}]+{word}", 1)).alias("after"),
        (F.lit(1.0) if seed else F.when(folded.rlike(OTHER), 0.0)).cast("double").alias("known"),
    )


def scores(edges: DataFrame) -> DataFrame:
    """``(value, score)`` of the unseen values of ``edges (pattern, value, known)`` that reach ``CONFIDENT`` after ``ROUNDS`` rounds."""
    scored = edges.withColumn("score", F.col("known"))
    for n in range(ROUNDS):
        sums = scored.filter("score is not null").groupBy("pattern").agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.count_if(F.col("score") >= CONFIDENT).alias("support"))
        patterns = sums.withColumn("confidence", F.col("total") / (F.col("n") + F.lit(DAMPING))).filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SEEDS)).select("pattern", "confidence")
        # noisy-or: 1 - product of (1 - confidence); only values that are neither seeds nor other formats
        open_ = edges.filter("known is null").select("pattern", "value")
        shown = cut(spread_join(open_, patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.coalesce(F.log1p(-F.col("confidence")), F.lit(0.0))))).alias("score")))
        if n + 1 < ROUNDS:
            # each value's patterns have its score of this round
            scored = edges.join(shown.select("value", F.col("score").alias("_shown")), "value", "left").withColumn("score", F.coalesce("known", "_shown")).drop("_shown")
    return shown.filter(F.col("score") >= CONFIDENT)


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, base, found)`` for each row: spans of the formats, and all spans."""
    need(df, id_col, text)
    whole = F.coalesce(F.col("text"), F.lit(""))
    read = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("seen", _found(whole))
    free = F.filter(matches(whole, IDENTIFIER, around=True), lambda m: ~F.exists("seen", lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"])))
    base = F.transform("seen", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))
    rows = read.select("id", base.alias("base"), F.concat(F.transform("seen", lambda m: m["token"]), F.transform(free, lambda m: surrounded(m, False))).alias("tokens"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    tokens = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    patterns = F.array(
        F.when(F.col("before") != "", F.xxhash64(F.lit(1), "before", "last")),
        F.when(F.col("last") != "", F.xxhash64(F.lit(2), "last", "shape")),
        F.when(F.col("after") != "", F.xxhash64(F.lit(3), "shape", "after")),
        F.xxhash64(F.lit(4), "shape"),
    )
    linked = tokens.select(F.explode(F.array_compact(patterns)).alias("pattern"), "value", "known")
    # a value that is a seed anywhere is one everywhere
    edges = linked.groupBy("pattern", "value").agg(F.max("known").alias("known"))
    known = edges.groupBy("value").agg(F.max("known").alias("most"))
    edges = cut(edges.join(known, "value").select("pattern", "value", F.col("most").alias("known")))
    unseen = cut(tokens.filter(F.col("known").isNull() & (F.col("stop") - F.col("start")).between(*LENGTH)).select("value", "row", "start", "stop"))
    shown = spread_join(unseen, scores(edges).select("value"), "value")
    added = shown.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit(CONTEXT).alias("kind"), "start", "stop"))).alias("added"))
    both = F.concat("base", F.coalesce("added", F.array().cast(SPAN)))
    return rows.join(added, "row", "left").select(F.col("id").alias(id_col), "base", both.alias("found"))
