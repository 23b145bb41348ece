"""Identity resolution: articles against the history of campaigns.

An article meets the campaign of its identity key; where there is none, all campaigns of its
semantic key.  Every meeting gets a decision from a ladder, first rule first, and the
article takes the decision that comes first in ``PREFERENCE``.  Both joins are equi-joins; the
preference is an aggregate, so an article with a long history needs no ordering.

Columns of both sides: ``identity_key, semantic_key, reference, apply_url, posted, deadline``
(dates), ``positions, salary, signature, strength``; articles have ``article_id`` and ``complete``
(whether the evidence stage is done), campaigns ``campaign_id``.  Null and blank are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Order of preference, and the limits of the ladder.
PREFERENCE = ("update", "duplicate", "hold", "new_campaign", "new")
ROLLOVER_AFTER_DEADLINE, ROLLOVER_AFTER_POST, REPOST, SAME_POST = 90, 330, 30, 3
STRONG, ENOUGH = 4, 6


def _present(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def _both(c: str) -> Column:
    return _present(f"a.{c}") & _present(f"r.{c}")


def rollover() -> Column:
    late = F.datediff("a.posted", "r.deadline") >= ROLLOVER_AFTER_DEADLINE
    return F.coalesce(late, F.lit(False)) | F.coalesce(F.datediff("a.posted", "r.posted") >= ROLLOVER_AFTER_POST, F.lit(False))


#: Compared columns of ``resolve``; ``COMPARED`` names all that a campaign's record may hold.
BASIC = ("positions", "deadline", "salary", "apply_url")
COMPARED = ("positions", "deadline", "salary", "contract", "location", "apply_url", "notice_type", "notice_status", "document_urls")


def compared(side: str, column: str) -> Column:
    """A column's text as it is compared: addresses in one form, those of documents sorted, no kind of notice a vacancy."""
    c = F.col(f"{side}.{column}")
    if column == "document_urls":
        return F.array_join(F.array_sort(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), urls.canonical_job), lambda u: u != "")), "|")
    if column == "apply_url":
        return urls.canonical_job(c)
    text = F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.when(text == "", F.lit("vacancy")).otherwise(text) if column == "notice_type" and side == "a" else text


def changed_columns(columns: tuple[str, ...] = COMPARED) -> Column:
    """The names of the compared columns in which an article ``a`` departs from a campaign ``r``, in their order."""
    return F.array_compact(F.array(*(F.when(compared("a", c) != compared("r", c), F.lit(c)) for c in columns)))


def material_change(columns: tuple[str, ...] = BASIC) -> Column:
    """A compared column differs, or complete and strong evidence does."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | (compared("a", c) != compared("r", c))
    return changed | (F.col("a.complete") & _both("signature") & (F.col("a.signature") != F.col("r.signature")) & (F.least("a.strength", "r.strength") >= STRONG))


def relation() -> Column:
    """Whether evidence shows the same campaign: ``same``, ``different``, ``pending`` or ``unknown``."""
    strong = _both("signature") & (F.least("a.strength", "r.strength") >= STRONG)
    return F.when(~F.col("a.complete"), "pending").when(strong & (F.col("a.signature") == F.col("r.signature")), "same").when(strong, "different").otherwise("unknown")


def same_family() -> Column:
    return urls.host(F.col("a.apply_url")) == urls.host(F.col("r.apply_url"))


def same_campaign() -> Column:
    """Evidence that two sources show one campaign: signatures, else weights of equal facts."""
    fact = lambda condition, weight: F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0)
    weights = (
        fact(_both("deadline") & (F.col("a.deadline") == F.col("r.deadline")), 1)
        + fact((F.col("a.positions") > 0) & (F.col("a.positions") == F.col("r.positions")), 1)
        + fact(F.abs(F.datediff("a.posted", "r.posted")) <= SAME_POST, 1)
        + fact(_both("apply_url") & same_family(), 4)
    )
    return F.col("a.complete") & ((relation() == "same") | ((relation() != "different") & (weights >= ENOUGH)))


def decision(columns: tuple[str, ...] = BASIC) -> Column:
    """The ladder for one article ``a`` and one campaign ``r``."""
    duplicate = F.when(F.col("a.complete"), F.lit("duplicate")).otherwise(F.lit("hold"))
    confirmed = F.when(~F.col("a.complete"), F.lit("hold")).when(material_change(columns), F.lit("update")).otherwise(F.lit("duplicate"))
    across = F.when(same_campaign(), duplicate).otherwise(F.lit("new_campaign"))
    ref = F.lower(F.trim("a.reference")) == F.lower(F.trim("r.reference"))
    apply_ = urls.canonical_job(F.col("a.apply_url")) == urls.canonical_job(F.col("r.apply_url"))
    return (
        F.when(rollover(), F.lit("new_campaign"))
        .when(_both("reference") & ref, confirmed)
        .when(_both("apply_url") & apply_, confirmed)
        .when(~F.col("a.semantic_key").eqNullSafe(F.col("r.semantic_key")), F.lit("new"))
        .when(_both("reference"), across)
        .when(_both("apply_url") & ~same_family(), across)
        .when(F.coalesce(F.abs(F.datediff("a.posted", "r.posted")) >= REPOST, F.lit(False)), F.lit("new_campaign"))
        .when(relation() == "same", duplicate)
        .when((relation() == "different") | F.col("a.complete"), F.lit("new_campaign"))
        .otherwise(F.lit("hold"))
    )


def resolve(articles: DataFrame, campaigns: DataFrame, columns: tuple[str, ...] = BASIC) -> DataFrame:
    """``(article_id, action, campaign_id)`` of every article; a change of one of ``columns`` is an update."""
    a, r = articles.alias("a"), campaigns.alias("r")
    exact = a.join(r, F.col("a.identity_key") == F.col("r.identity_key"))
    rest = a.join(r, F.col("a.identity_key") == F.col("r.identity_key"), "left_anti")
    loose = rest.join(r, F.col("a.semantic_key") == F.col("r.semantic_key"))
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("action")).alias("rank")
    met = exact.select("a.article_id", "r.campaign_id", decision(columns).alias("action")).union(loose.select("a.article_id", "r.campaign_id", decision(columns).alias("action")))
    best = met.groupBy("article_id").agg(F.min(F.struct(rank, "campaign_id", "action")).alias("best"))
    found = best.select(F.col("article_id").alias("_id"), "best.action", F.when(F.col("best.action") != "new", F.col("best.campaign_id")).alias("campaign_id"))
    return articles.join(found, F.col("article_id") == F.col("_id"), "left").select("article_id", F.coalesce("action", F.lit("new")).alias("action"), "campaign_id")
