"""DataFrame operators: deduplication, merging, ranking, sequences, similarity, graphs.

Every ranking has a total order, so reruns agree.  Groups are never collected
without a bound; where an operator orders within a key, the key is the caller's.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], *order: Column | str):
    return Window.partitionBy(*by).orderBy(*order)


# Deduplication and top-k


def keep_first(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return top_k(df, key, 1, *order)


def top_k(df: DataFrame, by: list[str], k: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(_w(by, *order))).filter(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def keep_best(df: DataFrame, key: list[str], confidence: Column, position: str) -> DataFrame:
    """The best row of each key, at the place where the key came first."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(confidence, -F.col(position)))
    return df.groupBy(*key).agg(best.alias("_best"), F.min(position).alias("first_position")).select(*key, "_best.*", "first_position")


def round_robin(df: DataFrame, group: str, limit: int, *order: Column | str) -> DataFrame:
    """Rows by turns of the groups: all firsts, then all seconds; the first ``limit``."""
    turn = F.row_number().over(_w([group], *order))
    return top_k(df, [group], limit, *order).withColumn("turn", turn).orderBy("turn", group).limit(limit)


def keep_newest(df: DataFrame, by: list[str], most: int, *newest: Column | str) -> DataFrame:
    return top_k(df, by, most, *newest)


# Merging


def upsert_non_blank(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All rows of both sides; a new value replaces the old unless it is null or blank."""
    of = {c: F.col(f"n.{c}") for c in columns}
    given = {c: F.when(F.trim(v.cast("string")) != "", v) for c, v in of.items()}
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    merged = [F.coalesce(given[c], F.col(f"o.{c}")).alias(c) for c in columns]
    state = F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "keep").otherwise("update")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *merged, state.alias("merge_state"))


def anti_by_any(df: DataFrame, other: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows that match none of the keys of the other side; one anti join a key."""
    for own, theirs in keys:
        df = df.join(other.select(F.col(theirs).alias("_key")).distinct(), F.col(own) == F.col("_key"), "left_anti")
    return df


def interval_unique(left: DataFrame, right: DataFrame, key: str, time: str, minutes: int, left_id: str, right_id: str) -> DataFrame:
    """Pairs of equal key at most ``minutes`` apart where the left row has exactly one such partner.

    The times are cut into buckets of that width and each right row goes to three, so the join is an
    equi-join on key and bucket: a frequent key spreads over its buckets.
    """
    width = minutes * 60
    second = lambda side: F.unix_seconds(F.col(f"{side}.{time}").cast("timestamp"))
    micro = lambda side: F.unix_micros(F.col(f"{side}.{time}").cast("timestamp"))
    a = left.alias("l").withColumn("bucket", F.floor(second("l") / width)).alias("l")
    b = right.alias("r").withColumn("bucket", F.floor(second("r") / width)).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).alias("r")
    near = F.abs(micro("l") - micro("r")) <= width * 1_000_000
    met = a.join(b, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.bucket") == F.col("r.bucket")) & near)
    pairs = met.select(F.col(f"l.{left_id}").alias("left_id"), F.col(f"r.{right_id}").alias("right_id"))
    return pairs.groupBy("left_id").agg(F.count("*").alias("n"), F.min("right_id").alias("right_id")).filter("n = 1").drop("n")


# Sequences


def islands(df: DataFrame, by: list[str], breaks: Column, *order: Column | str) -> DataFrame:
    """Add ``island``: the number of breaks up to and including the row."""
    return df.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(_w(by, *order).rowsBetween(Window.unboundedPreceding, 0)))


def streak_cut(df: DataFrame, by: list[str], known: Column, stop: int, *order: Column | str) -> DataFrame:
    """Rows up to and including the first that ends ``stop`` known rows in a row; adds ``streak``."""
    marked = islands(df.withColumn("_known", known), by, ~F.col("_known"), *order)
    run = F.sum(F.when(F.col("_known"), 1).otherwise(0)).over(_w([*by, "island"], *order).rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("streak", run)
    ended = F.sum(F.when(F.col("streak") >= stop, 1).otherwise(0)).over(_w(by, *order).rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0").drop("_known", "island", "_ended")


def tail_streak(df: DataFrame, by: list[str], holds: Column, most: int, *newest: Column | str) -> DataFrame:
    """For each group the number of its newest rows, of at most ``most``, that hold without a break."""
    newest_rows = top_k(df.withColumn("_holds", holds), by, most, *newest, rank="_rank")
    broken = F.min(F.when(~F.col("_holds"), F.col("_rank")))
    return newest_rows.groupBy(*by).agg((F.coalesce(broken, F.count("*") + 1) - 1).cast("long").alias("streak"))


def clamped_fold(df: DataFrame, by: list[str], order: str, delta: str, low: int, high: int) -> DataFrame:
    """Running ``score = clamp(score + delta)`` over each group in order; the final score.

    The order's rows are gathered for each group, so a group is a bounded history.
    """
    steps = F.array_sort(F.collect_list(F.struct(order, delta)))
    fold = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: F.greatest(F.lit(low), F.least(F.lit(high), acc + s[delta])))
    return df.groupBy(*by).agg(fold.alias("score"), F.count("*").alias("steps"))


def age_bands(df: DataFrame, key: list[str], age: Column, bands: dict[str, tuple[float, float]], *order: Column | str) -> DataFrame:
    """One sample of each key and band: rows whose age is in the band, the first by order."""
    at = F.array(*(F.struct(F.lit(i).alias("priority"), F.lit(n).alias("band"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for i, (n, (a, b)) in enumerate(bands.items())))
    rows = df.withColumn("_age", age).withColumn("_band", F.explode(at)).filter("_age >= _band.low and _age <= _band.high")
    return top_k(rows.withColumn("band", F.col("_band.band")), [*key, "band"], 1, "_age", *order).drop("_band")


# Aggregates


def zero_filled(domain: DataFrame, facts: DataFrame, key: str, fact_key: str) -> DataFrame:
    """Counts of facts for every member of the domain."""
    counts = facts.groupBy(F.col(fact_key).alias("_key")).agg(F.count("*").alias("n"))
    return domain.join(counts, F.col(key) == F.col("_key"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("_key")


def histogram(df: DataFrame, labels: Column, limit: int) -> DataFrame:
    """The most frequent labels, each counted once a row; ties by label."""
    counted = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "label").limit(limit)


def consensus(df: DataFrame, by: list[str], value: str, otherwise: Column) -> DataFrame:
    """A group's value if all agree on one."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*by).agg(F.when(low == high, low).otherwise(otherwise).alias("consensus"))


# Similarity and graphs


def classes(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, rep)`` of every row with tokens: rows of equal token sets are one class, its smallest key the representative."""
    sets = df.select(key, F.array_sort(F.array_distinct(tokens)).alias("_set")).filter(F.size("_set") > 0)
    return sets.join(sets.groupBy("_set").agg(F.min(key).alias("rep")), "_set").select(key, "rep")


def overlap_pairs(df: DataFrame, key: str, tokens: str, least: float, marked: str | None = None) -> DataFrame:
    """``(left, right, shared, larger)``: pairs of representatives of different token sets with ``shared / larger >= least``.

    Equal sets are one class, so copies do not make pairs; ``classes`` gives the members.  Prefix filtering: two sets that share so
    much have a common token among the first ``size - ceil(least * size) + 1`` of each, rarest first.  With ``marked``, a
    pattern, any shared token links two sets of which one has a token that matches.
    """
    sets = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(tokens)).alias("tokens")).filter(F.size("tokens") > 0)
    reps = sets.groupBy("tokens").agg(F.min("key").alias("rep"))
    counts = reps.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rare = reps.select("rep", F.explode("tokens").alias("token")).join(counts, "token")
    ordered = rare.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda t: t["token"]).alias("tokens"))
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - F.ceil(F.lit(least) * n).cast("int") + 1)
    posted = ordered.select("rep", n.alias("n"), "tokens", F.explode(prefix).alias("token"))
    a, b = posted.alias("a"), posted.alias("b")
    size = (F.col("a.n") >= F.col("b.n") * least) & (F.col("b.n") >= F.col("a.n") * least)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.rep") < F.col("b.rep")) & size)
    shape = lambda d: d.select(F.least("a.rep", "b.rep").alias("left"), F.greatest("a.rep", "b.rep").alias("right"), F.size(F.array_intersect("a.tokens", "b.tokens")).alias("shared"), F.greatest("a.n", "b.n").alias("larger")).distinct()
    found = shape(met).filter(F.col("shared") / F.col("larger") >= least)
    if marked is None:
        return found
    every = ordered.select("rep", n.alias("n"), "tokens", F.explode("tokens").alias("token"))
    some = every.filter(F.exists("tokens", lambda t: t.rlike(marked)))
    also = some.alias("a").join(every.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.rep") != F.col("b.rep")))
    return found.union(shape(also)).distinct()


def linked_classes(df: DataFrame, key: str, tokens: str, pairs: DataFrame) -> DataFrame:
    """``(key, rep, links)``: every row's class, and how many other classes it is linked to by ``pairs (left, right)``."""
    ends = pairs.select(F.explode(F.array("left", "right")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return classes(df, key, tokens).join(ends, "rep", "left").select(key, "rep", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def duplicate_reasons(df: DataFrame, key: str, by: list[tuple[str, str]], similar: DataFrame | None = None) -> DataFrame:
    """``(key, reason, earlier)``: why a row repeats an earlier one, by the first of ``by (reason, column)`` that it shares with one.

    ``similar (key, earlier)`` are rows that resemble an earlier one; that reason, ``similar``, is the last.  One aggregate and equi-join a column.
    """
    found = None
    for rank, (reason, column) in enumerate(by):
        first = df.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(F.col(column).alias("_v")).agg(F.min(key).alias("_first"))
        met = df.join(first, (F.col(column) == F.col("_v")) & (F.col(key) > F.col("_first"))).select(key, F.struct(F.lit(rank).alias("rank"), F.lit(reason).alias("reason"), F.col("_first").alias("earlier")).alias("m"))
        found = met if found is None else found.union(met)
    if similar is not None:
        found = found.union(similar.select(key, F.struct(F.lit(len(by)).alias("rank"), F.lit("similar").alias("reason"), "earlier").alias("m")))
    return found.groupBy(key).agg(F.min("m").alias("m")).select(key, "m.reason", "m.earlier")


def related(df: DataFrame, key: str, within: str, weights: dict[str, int], k: int) -> DataFrame:
    """``(key, related, points, place)``: for every row the ``k`` rows of its group with most points, a column's weight where both have its value.

    A row that shares just the columns M with another is among the ``k`` best only if fewer than ``k`` rows of smaller key share M at least;
    so each row meets the first ``k + 1`` of every group of equal M, not its whole group.
    """
    names = list(weights)
    rows = df.select(key, within, *names)
    found = None
    for n in range(1, len(names) + 1):
        for some in itertools.combinations(names, n):
            by = [within, *some]
            first = top_k(rows.dropna(subset=by), by, k + 1, key).withColumnsRenamed({c: f"_{c}" for c in rows.columns})
            same = [F.col(c) == F.col(f"_{c}") for c in by]
            met = rows.join(first, [*same, F.col(key) != F.col(f"_{key}")])
            points = sum((F.when(F.col(c) == F.col(f"_{c}"), w).otherwise(0) for c, w in weights.items()), F.lit(0))
            met = met.select(key, F.col(f"_{key}").alias("related"), points.alias("points"))
            found = met if found is None else found.union(met)
    return top_k(found.distinct(), [key], k, F.desc("points"), "related", rank="place")


def outer_merge(first: DataFrame, second: DataFrame, key: str, value: str, flag: str) -> DataFrame:
    """``(key, value, flag)`` of both sides: the first side's value where it has one, the flag of either."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce(f"a.{value}", f"b.{value}").alias(value), (yes(f"a.{flag}") | yes(f"b.{flag}")).alias(flag))


def all_failed(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """Groups in which every row failed, with their number."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(failed).alias("_all")).filter("_all").drop("_all")


def mean_tenths(cents: Column, n: Column, places: int) -> Column:
    """The mean of a sum of cents, rounded half up to some decimal places, by whole numbers alone."""
    unit = 10**places
    return (F.floor((cents * (2 * unit) + n * 100) / (n * 200)) / unit).cast("double")


def anchors(pages: DataFrame, page_url: str, href: str, key) -> DataFrame:
    """``(src, dst)``: distinct links between known pages, none to the page itself; ``key`` makes two addresses comparable."""
    known = pages.select(key(F.col(page_url)).alias("_known")).distinct()
    edges = pages.select(key(F.col(page_url)).alias("src"), F.explode(href).alias("_h")).select("src", key(F.col("_h")).alias("dst")).filter("src <> dst").distinct()
    return edges.join(known, F.col("dst") == F.col("_known"), "left_semi")


def planned(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """Planned edges that are not there yet."""
    return plan.join(edges, ["src", "dst"], "left_anti")


def degrees(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """In- and out-degree of every node over distinct edges without loops, and whether none leads to it."""
    links = edges.filter("src <> dst").distinct()
    out = links.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("out_degree"))
    into = links.groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("in_degree"))
    joined = nodes.join(out, F.col(key) == F.col("_s"), "left").join(into, F.col(key) == F.col("_d"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select(key, zero("in_degree"), zero("out_degree")).withColumn("orphan", F.col("in_degree") == 0)
