"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

``targets`` shares a token budget among sources by weight, none above a multiple
of its own size.  ``mix`` allocates *blocks* of ``block_tokens`` tokens to sources
by highest quotients ``target / (2 k - 1)``, then each source's blocks to its
*shards* (hash buckets of its rows) by highest quotients of the shards' sizes, which
gives every shard an integer quota.  What the blocks lack of a source's target, or exceed it by, at most half a block,
its largest shard makes up with a partial block, so that a source smaller than a block has its words too.
A shard lays its rows end to end in seeded order, cuts that stream into blocks
and takes as many words as its quota says: whole epochs first, then blocks at a seeded
stride, the last one in part.  No word is taken more than ``max_epochs`` times.

Scale: the quotients of a seat that can go either way are few: with divisor ``total /
(seats - n / 2)`` rounding gives at most the seats wanted, with ``total / (seats +
n / 2)`` at least as many, so only the seats between are ranked, about two a member.
Rows meet by (source, shard); a source has shards by its own rows and words, so that what is left over
of a shard is little beside it, whatever else there is.  One row for each source, and one for each shard of a source,
is all that is ordered in one place.  Nothing is collected or broadcast by this module.

Defined results: sources are ordered by code point, a null source is a source of its
own and comes last; a null text has size 0; rows of size 0 are never taken; an
empty table gives no rows; repeated rows count each; rows equal in id, text and source may swap what
is taken of them.  Only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free, need, spread_join

#: None of a block count under 10^15 is a multiple of five of these.
STRIDES = (1_009, 10_007, 100_003, 1_000_003, 10_000_019)
ROWS_PER_SHARD = 4_096
#: Blocks of a shard, at least, where a source has more than one.
BLOCKS_PER_SHARD = 128
SEED = 42


def words(text: Column) -> Column:
    """Words of a text: maximal runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to ``sources (source, source_size)``: water filling of ``budget`` times all sizes.

    Weights go to sources in code-point order, null last, repeating.  A source's target
    stops at ``max_epochs`` times its size; what it leaves goes to the others by weight.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.array(*map(F.lit, map(float, weights)))[rank % len(weights)]
    full = F.col("cap") / F.col("weight")  # the level at which a source is full
    before = Window.partitionBy(F.lit(0)).orderBy("full", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full", full)
        .withColumn("level", level)
        # the first source, by rising level of fullness, that the remaining budget cannot fill fixes the level
        .withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("full", F.asc_nulls_last("source"))))
        .withColumn("fixed", F.min(F.when(F.col("level") < F.col("full"), F.struct("place", "level"))).over(everything)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def apportion(members: DataFrame, within: list[str], size: str, seats: Column, most: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: integer seats of each row among those equal in ``within``, by Sainte-Lague.

    ``seats`` is the number to give out in each group.  ``most`` is a row's upper bound; it cuts what
    rounding adds and is not passed on, as targets have passed on what is above their bounds.
    """
    group = Window.partitionBy(*within)
    rounded = lambda wanted: F.least(F.col("_most"), F.floor(F.col(size) * F.greatest(wanted, F.lit(0.0)) / F.col("_all") + 0.5))
    spread = (
        members.withColumns({"_seats": seats.cast("long"), "_most": most.cast("long"), "_all": F.sum(size).over(group).cast("double"), "_n": F.count("*").over(group)})
        .withColumn("_low", F.when(F.col("_all") > 0, rounded(F.col("_seats") - F.col("_n") / 2)).otherwise(0).cast("long"))
        .withColumn("_high", F.when(F.col("_all") > 0, rounded(F.col("_seats") + F.col("_n") / 2)).otherwise(0).cast("long"))
        .withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    )
    open_seats = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.greatest("_high", F.col("_low") + 1)))
    ranked = spread.withColumn("_k", F.explode_outer(open_seats)).withColumn(
        "_rank", F.row_number().over(group.orderBy(F.desc_nulls_last(F.col(size) / (2 * F.col("_k") - 1)), *order, "_k"))
    )
    own = [c for c in members.columns]
    won = F.count(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1))
    return ranked.groupBy(*own).agg((F.first("_low") + won).alias(name))


def _keys(seed: int, *columns: Column) -> list[Column]:
    """Two hashes of a row's id, text and source, 128 bits together."""
    return [F.xxhash64(F.lit(seed), *columns), F.xxhash64(F.lit(seed + 2), *columns)]


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: int = 2,
    block_tokens: int = 32,
    rows_per_shard: int = ROWS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """``(id_col, key, key2, size, source, source_size, target, taken, epochs, runs)`` for each row.

    ``taken`` words of a row go into the mix: all of them ``epochs`` times, and once more
    those in ``runs``, an array of word ranges ``(start, stop)``.  ``key, key2`` are hashes of
    id, text and source, by which rows can be joined back.
    """
    need(df, id_col, text, source)
    key, key2 = _keys(seed, F.col(id_col), F.col(text), F.col(source))
    sized = cut(df.select(F.col(id_col).alias("id"), key.alias("key"), key2.alias("key2"), F.col(source).alias("source"), words(F.col(text)).alias("size")))
    sized = sized.withColumns({"none": F.col("source").isNull(), "named": F.coalesce("source", F.lit(""))})
    shards = F.least(F.ceil(F.count("*") / rows_per_shard), F.floor(F.sum("size") / (block_tokens * BLOCKS_PER_SHARD)))
    origin = F.struct("none", "named").alias("origin")
    shards = sized.groupBy(origin).agg(F.greatest(shards, F.lit(1)).cast("long").alias("shards"))
    # a source may hold a third of all rows
    sized = spread_join(sized.select("id", "key", "key2", "size", origin), shards, "origin").select("id", "key", "key2", "size", "origin.*", F.pmod("key", "shards").alias("shard"))
    by = ["none", "named", "shard"]
    per_shard = sized.groupBy(*by).agg(F.sum("size").alias("shard_size"))
    per_source = per_shard.groupBy("none", "named").agg(F.sum("shard_size").alias("source_size"))
    aimed = targets(per_source.select(F.when(~F.col("none"), F.col("named")).alias("source"), "source_size"), weights, budget, max_epochs)
    aimed = aimed.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target")
    block, most = F.lit(block_tokens).cast("long"), F.lit(max_epochs).cast("long")
    all_blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block)
    for_source = aimed.withColumn("all_blocks", all_blocks).withColumn("one", F.lit(0))
    for_source = apportion(for_source, ["one"], "target", F.col("all_blocks"), F.floor(F.col("source_size") * most / block), [F.col("none"), F.col("named")], "source_blocks")
    quota = per_shard.join(for_source, ["none", "named"])
    quota = apportion(quota, ["none", "named"], "shard_size", F.col("source_blocks"), F.floor(F.col("shard_size") * most / block), [F.col("shard")], "quota")
    # words of each shard: its blocks, and in the largest shard what the source's blocks leave over
    source = Window.partitionBy("none", "named")
    largest = F.row_number().over(source.orderBy(F.desc("shard_size"), "shard")) == 1
    left = F.round("target").cast("long") - F.sum("quota").over(source) * block
    full = F.col("target") >= F.col("source_size") * most
    wanted = F.when(full, F.col("shard_size") * most).otherwise(F.col("quota") * block + F.when(largest, left).otherwise(0))
    quota = quota.withColumn("wanted", F.greatest(F.lit(0), F.least(wanted, F.col("shard_size") * most)))
    draw = F.xxhash64(F.lit(seed + 1), *by)
    blocks = F.floor(F.col("shard_size") / block)
    strides = F.filter(F.array(*(F.lit(s).cast("long") for s in STRIDES)), lambda s: (F.col("blocks") == 0) | (F.col("blocks") % s != 0))
    some = F.greatest("shard_size", F.lit(1))  # a shard without words wants none
    quota = quota.withColumns({"blocks": blocks, "rest": F.col("wanted") % some}).select(
        *by,
        "source_size",
        "target",
        "blocks",
        F.floor(F.col("wanted") / some).cast("int").alias("epochs"),
        # whole blocks that are taken once more, and the words of the one that is taken in part
        F.least(F.floor(F.col("rest") / block), F.col("blocks")).alias("rest"),
        (F.col("rest") - F.least(F.floor(F.col("rest") / block), F.col("blocks")) * block).alias("part"),
        strides[F.pmod(draw, F.size(strides)).cast("int")].alias("stride"),
        F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(draw), F.greatest("blocks", F.lit(1)))).otherwise(0).alias("offset"),
    )
    stream = Window.partitionBy(*by).orderBy("key", "key2", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # by shard, and not as the rows come from the join by source
    laid = sized.repartition(*by).withColumn("end", F.sum("size").over(stream)).join(quota, by).withColumn("start", F.col("end") - F.col("size"))
    laid = laid.withColumn("epochs", F.when(F.col("size") > 0, F.col("epochs")).otherwise(0))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    blocks_of = F.when((F.col("end") > F.col("start")) & (F.col("rest") + F.col("part") > 0), F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))

    def words_of(b: Column) -> Column:
        """Words that are taken once more of a block; the last block, where all others are taken, is the stream's short end."""
        rank = F.when(b < F.col("blocks"), F.pmod(b * F.col("stride") + F.col("offset"), F.greatest("blocks", F.lit(1)))).otherwise(b)
        return F.when(rank < F.col("rest"), block).when(rank == F.col("rest"), F.col("part")).otherwise(0)

    runs = F.transform(
        F.transform(blocks_of, lambda b: F.struct((b * block).alias("from"), (b * block + words_of(b)).alias("to"))),
        lambda r: F.struct((F.greatest(F.col("start"), r["from"]) - F.col("start")).alias("start"), (F.least(F.col("end"), r["to"]) - F.col("start")).alias("stop")),
    )
    laid = laid.withColumn("runs", F.coalesce(F.filter(runs, lambda r: r["stop"] > r["start"]), F.array().cast("array<struct<start: bigint, stop: bigint>>")))
    extra = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    named = F.when(~F.col("none"), F.col("named")).alias("source")
    return laid.select(F.col("id").alias(id_col), "key", "key2", "size", named, "source_size", "target", (F.col("size") * F.col("epochs") + extra).alias("taken"), "epochs", "runs")


def materialise(df: DataFrame, taken: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``df`` that ``taken``, of ``mix`` over ``df``, takes.

    A row comes whole once an epoch, and once more with the words of its runs, white space
    after them included, if only some of its words are taken again.  Rows of ``df`` that are equal in id, text and source
    take what ``taken`` has for them one by one; their other columns stay their own, whatever the names.
    """
    need(df, id_col, text, source)
    key, key2, shares, nth, part = (free(df, f"_{c}") for c in ("key", "key2", "shares", "nth", "part"))
    hashes = _keys(seed, F.col(id_col), F.col(text), F.col(source))
    # more than one share only where a row is repeated
    share = taken.groupBy(F.col("key").alias(key), F.col("key2").alias(key2)).agg(F.collect_list(F.struct("size", "epochs", "runs")).alias(shares))
    rows = df.withColumns({key: hashes[0], key2: hashes[1]}).join(share, [key, key2])
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, key2).orderBy(key)))
    rows = rows.withColumn(shares, F.get(F.col(shares), F.col(nth) - 1))
    again = F.when(F.size(F.col(shares)["runs"]) > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    copies = rows.withColumn(part, F.explode(F.concat(F.array_repeat(F.lit(False), F.col(shares)["epochs"]), again)))
    each = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    runs = F.col(shares)["runs"]
    parts = F.flatten(F.transform(runs, lambda r: F.slice(each, (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int"))))
    whole = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]) == F.col(shares)["size"]
    return copies.withColumn(text, F.when(F.col(part) & ~whole, F.array_join(parts, "")).otherwise(F.col(text))).select(*df.columns)
