"""Candidates for publication: the application policy, the assessment, and the three rankings.

Columns of a candidate: ``source, source_priority, title, url, detail_url, apply_url, apply_email,
link_kind, apply_source, notice_type, eligibility, kind, education, location, diploma, salary`` (text),
``official, email_verified, needs_account, retired, rolling, entry_level, date_only`` (boolean),
``positions`` (int), ``deadline, published, discovered`` (timestamp), ``actions``
(array of ``kind, url``: the links that the page shows as actions) and ``document_texts`` (array of
text).  Null is absent: no address, no kind, not official.  All operators keep the given columns
and the number of rows; they are narrow, so nothing is shuffled but by the rankings.

Addresses are brought to one form once for each row (``addressed``), since every rule compares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, ladders, times, urls

# Hosts of public bodies, hosts that need an account, kinds of links that are no action.
PUBLIC_HOSTS = ("emploi-public.ma",)
PUBLIC_SUFFIXES = (".gov.ma", ".ac.ma")
ACCOUNT_HOSTS = ("moncallcenter.ma", "rekrute.com")
NO_ACTION = ("official_job_page", "listing", "generic")
# Addresses that are an application form, those that ask for an account, and a mail address.
DIRECT = (
    r"(?i)(?:/(?:apply|postuler|candidater|candidature/submit|applications?/new|"
    r"applicationform)(?:/|[.?]|$)|[?&](?:apply|postuler|lJobID|jobId)=)"
)
ACCOUNT = (
    r"(?i)/(?:login|sign[-_]?in|sign[-_]?up|register|registration|"
    r"inscription|connexion|auth(?:entication)?|create[-_]?account|"
    r"mon[-_]?compte|candidate[-_]?account)(?:/|[.?]|$)"
)
ACCOUNT_NEXT = r"(?i)(?:^|[?&])(?:redirect|returnUrl|next)=[^&]*(?:login|register|signup)"
MAIL = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"
# Eligibility that is known, sources of rank, titles that name a list.
ELIGIBLE = ("morocco", "remote_morocco", "abroad_open", "visa_confirmed")
TOP_PRIORITIES = ("s+", "s", "a+")
LIST_TITLES = ("jobs", "job", "careers", "career", "recruitment", "recrutement", "vacancies", "opportunities", "emploi", "offres d emploi")
# Ranks of states, of sources' priorities and of urgency.
STATUS_RANK = {"selected": 4, "ready": 3, "identity_pending": 2, "draft_created": 1}
SOURCE_RANK = {"S+": 6, "S": 5, "A+": 4, "A": 3, "B+": 2, "B": 1}
URGENCY_RANK = {"critical": 2, "high": 2, "elevated": 1}
URGENCY_BOOST = {"critical": 4.0, "high": 3.0, "elevated": 1.5}

_WORKING = ("_apply", "_detail", "_mail", "_host", "_own", "_specific", "_exposed", "_portal")


def _text(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _low(c: Column | str) -> Column:
    return F.lower(_text(c))


def _yes(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _ranked(table: dict[str, float], key: Column, otherwise: float = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(otherwise))


def is_web(url: Column) -> Column:
    """Whether a text is an address of the web."""
    return F.lower(urls.part(url, 1)).isin("http", "https") & (urls.part(url, 2) != "")


def is_public_host(host: Column) -> Column:
    """Whether a host belongs to a public body."""
    found = host.isin(*PUBLIC_HOSTS)
    for suffix in PUBLIC_SUFFIXES:
        found = found | F.endswith(host, F.lit(suffix))
    return found


def addressed(df: DataFrame) -> DataFrame:
    """Add the working columns that the rules share: addresses in one form, and what they are."""
    first = df.withColumns({
        "_apply": urls.canonical_job(_text("apply_url")),
        "_detail": urls.canonical_job(F.coalesce(keys.present(F.col("detail_url")), keys.present(F.col("url")), F.lit(""))),
        "_mail": F.when(F.startswith(_low("apply_url"), F.lit("mailto:")), F.trim(F.substring_index(F.substring(_low("apply_url"), 8, 10_000), "?", 1))),
    })
    second = first.withColumns({
        "_host": urls.host(F.col("_apply")),
        "_own": urls.host(F.col("_detail")),
        "_specific": keys.is_job_specific(F.col("_apply")),
    })
    # an address of another host, or the very same text, needs no canonical form
    same = lambda u: (F.trim(u) == _text("apply_url")) | (urls.canonical_job(u) == F.col("_apply"))
    is_shown = lambda a: (F.lower(F.trim(a["kind"])) == "apply") & F.contains(F.lower(a["url"]), F.col("_host")) & same(a["url"])
    third = second.withColumn("_exposed", (F.col("_apply") != "") & _yes(F.exists("actions", is_shown)))
    return third.withColumn("_portal", _verified_portal())


def _verified_portal() -> Column:
    """An address without a vacancy that the specific notice of a public competition shows as its action."""
    host, own = F.col("_host"), F.col("_own")
    notice = (_low("notice_type") == "competition") & _yes("official") & keys.is_job_specific(F.col("_detail"))
    return is_web(F.col("_apply")) & ~F.col("_specific") & notice & F.col("_exposed") & ((host == own) | is_public_host(host))


def _mail_proved() -> Column:
    return _yes((_low("apply_email") == F.col("_mail")) & F.col("_mail").rlike(MAIL)) & _yes("email_verified") & _yes("official")


def _bound() -> Column:
    own = F.col("_specific") & ~keys.is_foreign_detail(F.col("_detail"), F.col("_apply"))
    return F.when(F.col("_mail").isNotNull(), _mail_proved()).when(~is_web(F.col("_apply")), False).otherwise(own | F.col("_portal"))


def _refusal() -> Column:
    """The ladder of refusals, first rule first; an accepted branch is an empty reason."""
    url, apply_, host = _text("apply_url"), F.col("_apply"), F.col("_host")
    platform = host.isin(*ACCOUNT_HOSTS) | _yes("needs_account")
    for name in ACCOUNT_HOSTS:
        platform = platform | F.endswith(host, F.lit(f".{name}"))
    kind = _low("link_kind")
    channel, direct = kind == "official_application_channel", url.rlike(DIRECT)
    bare = F.lower(F.regexp_replace(url, "/+$", ""))
    in_document = F.exists(F.coalesce("document_texts", F.array().cast("array<string>")), lambda t: F.contains(F.lower(F.coalesce(t, F.lit(""))), bare))
    unproved = (_low("apply_source") == "official_pdf") & ~in_document
    return ladders.first_of(
        (_yes("retired"), "retired_source"),
        (F.col("_mail").isNotNull() & ~_mail_proved(), "mail_not_verified"),
        (F.col("_mail").isNotNull(), ""),
        (~is_web(url), "no_direct_address"),
        (urls.part(apply_, 3).rlike(ACCOUNT) | urls.part(apply_, 4).rlike(ACCOUNT_NEXT), "sign_in_page"),
        (channel & ~F.col("_portal"), "portal_not_verified"),
        (channel & unproved, "portal_not_in_document"),
        (channel, ""),
        (kind.isin(*NO_ACTION), "not_an_action"),
        (~F.col("_specific") | ~F.col("bound"), "generic_or_other_vacancy"),
        ((F.col("_detail") == apply_) & ~direct, "description_page"),
        (~(F.col("_exposed") | (kind == "direct_apply") | direct), "no_apply_action"),
        (platform & ~F.col("_exposed"), "account_not_verified"),
    )


def applied(df: DataFrame) -> DataFrame:
    """Add ``bound`` (the address belongs to this vacancy) and ``refusal`` (why it is refused; empty for a good one)."""
    return addressed(df).withColumn("bound", _bound()).withColumn("refusal", _refusal()).drop(*_WORKING)


def indicators(now: Column) -> dict[str, Column]:
    """The twelve indicators of the selection score, of a candidate with ``bound``, ``focus`` and ``age``."""
    age = F.col("age")
    return {
        "official": _yes("official"),
        "fresh": age["fresh"],
        "very_fresh": _yes(age["fresh"] & ~_yes("date_only") & (age["age_hours"] <= 12)),
        "focus": _yes(F.col("focus") > 0),
        "priority": _low("source_priority").isin(*TOP_PRIORITIES),
        "many_positions": _yes(F.col("positions") >= 10),
        "deadline": F.col("deadline").isNotNull(),
        "location": _text("location") != "",
        "diploma": _text("diploma") != "",
        "application": F.col("bound"),
        "salary": _text("salary") != "",
        "entry_level": _yes("entry_level"),
    }


def assessed(df: DataFrame, now: Column) -> DataFrame:
    """Add ``points`` (a map of the twelve indicators), ``score`` (0 to 100), ``reasons`` and ``standing``.

    ``df`` has ``focus`` beside a candidate's columns.  The score only ranks: ``standing`` is ``publish``
    without reasons, ``reject`` for one that time does not mend, else ``queue``.
    """
    from . import gates

    aged = applied(df).withColumns({
        "age": times.freshness(F.col("published"), _yes("date_only"), F.coalesce("kind", F.lit("job")), now),
        "_policy": gates.publication_policy(F.col("deadline"), F.col("rolling"), F.coalesce("education", F.lit("unverified")), now),
        "_list": F.trim(F.regexp_replace(_low("title"), r"[^\p{L}\p{N}]+", " ")).isin(*LIST_TITLES),
    })
    points = F.create_map(*(x for name, holds in indicators(now).items() for x in (F.lit(name), F.when(holds, ladders.SCORE[name]).otherwise(0))))
    age, notice = F.col("age"), F.coalesce(F.nullif(_low("notice_type"), F.lit("")), F.lit("vacancy"))
    over = notice.isin("vacancy", "competition") & _yes(F.col("deadline") < now)
    no_page = ~is_web(F.col("url"))
    known, stale = age["known"], age["known"] & ~age["future"] & ~age["fresh"]
    own = ladders.reasons(
        (~_low("eligibility").isin(*ELIGIBLE), "eligibility_unknown"),
        (no_page, "no_page"),
        (~F.col("bound"), "no_application"),
        (~known, "publication_unknown"),
        (age["future"], "published_in_future"),
        (stale, "too_old"),
        (F.col("_list"), "list_page"),
        (over, "expired"),
    )
    refused = F.when(F.col("refusal") != "", F.array("refusal")).otherwise(F.array().cast("array<string>"))
    final = over | F.col("_policy.permanent_reject") | age["future"] | stale | no_page | F.col("_list")
    found = aged.withColumns({"points": points, "reasons": F.concat(own, F.col("_policy.reasons"), refused), "_final": final})
    total = F.aggregate(F.map_values("points"), F.lit(0), lambda a, b: a + b)
    return found.withColumns({
        "score": F.greatest(F.lit(0), F.least(F.lit(100), total)),
        "standing": F.when(F.size("reasons") == 0, "publish").when(F.col("_final"), "reject").otherwise("queue"),
    }).drop("_policy", "_list", "_final", "age")


def urgency(now: Column) -> Column:
    """How urgent a candidate is, by its whole and part days to the deadline."""
    days = (times.micros(F.col("deadline")) - times.micros(now)) / 86_400_000_000
    notice = F.coalesce(F.nullif(_low("notice_type"), F.lit("")), F.lit("vacancy"))
    return ladders.urgency(notice, _yes("official"), days, F.greatest(F.lit(0), F.coalesce("positions", F.lit(0))))


# Rankings: each is a list of sort columns, whose last one breaks ties by the order of the queue


def selection_order(served: Column, position: Column, now: Column) -> list[Column]:
    """Which candidate is published next: urgency, the source served longest ago (never first), newest, focus, found last, score."""
    epoch = lambda c: F.coalesce(times.micros(c), F.lit(0))
    level = _ranked(URGENCY_RANK, urgency(now))
    return [level.desc(), epoch(served).asc(), epoch(F.col("published")).desc(), F.coalesce("focus", F.lit(0)).desc(), epoch(F.col("discovered")).desc(), F.col("score").desc(), position.asc()]


def social_points(queued: Column, now: Column) -> Column:
    """``(points, due, waited)``: nearness of the deadline, days of waiting (at most fourteen), and urgency."""
    hours = F.greatest(F.lit(0.0), (times.micros(F.col("deadline")) - times.micros(now)) / 3_600_000_000)
    due = F.when(F.col("deadline").isNull(), 0.0).otherwise(ladders.deadline_points(hours).cast("double"))
    waited = F.least(F.lit(14.0), F.greatest(F.lit(0.0), F.coalesce((times.micros(now) - times.micros(queued)) / 86_400_000_000, F.lit(0.0))))
    boost = _ranked(URGENCY_BOOST, urgency(now), 0.0)
    return F.struct((due + waited + boost).alias("points"), due.alias("due"), waited.alias("waited"))


def social_order(points: Column, queued: Column, position: Column) -> list[Column]:
    """Which article is posted next, of its ``social_points``: points, deadline, waiting, score, positions, first in."""
    clipped = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("score", F.lit(0))))
    first_in = F.when(queued.isNotNull(), -times.micros(queued)).otherwise(0)
    return [points["points"].desc(), points["due"].desc(), points["waited"].desc(), clipped.desc(), F.greatest(F.lit(0), F.coalesce("positions", F.lit(0))).desc(), first_in.desc(), position.asc()]


def deadline_rank(deadline: Column, now: Column) -> Column:
    """6 within a day down to 1 beyond a month; 0 without a deadline, -1 past it."""
    hours = (times.micros(deadline) - times.micros(now)) / 3_600_000_000
    ladder = F.when(hours < 0, -1).when(hours <= 24, 6).when(hours <= 72, 5).when(hours <= 168, 4).when(hours <= 336, 3).when(hours <= 720, 2)
    return F.when(deadline.isNull(), 0).otherwise(ladder.otherwise(1))


def enrichment_order(status: Column, queue_score: Column, position: Column, now: Column) -> list[Column]:
    """Which page is read next: nearest deadline, focus, newest, state, the better score, source, place in the queue."""
    newest = F.coalesce(times.micros(F.coalesce("published", "discovered")), F.lit(0))
    best = F.greatest(F.coalesce("score", F.lit(0)), F.coalesce(queue_score, F.lit(0)) * 10)
    source = _ranked(SOURCE_RANK, F.upper(_text("source_priority"))) + F.when(_yes("official"), 2).otherwise(0)
    return [deadline_rank(F.col("deadline"), now).desc(), F.coalesce("focus", F.lit(0)).desc(), newest.desc(), _ranked(STATUS_RANK, F.trim(status)).desc(), best.desc(), source.desc(), position.asc()]


def prepared(df: DataFrame, decisions: DataFrame, key: str, now: Column) -> DataFrame:
    """``assessed`` candidates with what a publication needs: ``labels, urgency, action, campaign_id, slug``.

    ``decisions`` has one row of ``(key, action, campaign_id)`` for each candidate of
    ``identity.resolve``; one without a decision is ``new``.  An update keeps its campaign, a new campaign's id
    is a hash of the candidate's, so that a second run gives the same; others have none.  ``df`` has ``company, country,
    remote, visa`` beside a candidate's columns.
    """
    from ..functions import slugs
    from . import gates

    found = decisions.select(F.col(key).alias("_key"), F.col("action").alias("_action"), F.col("campaign_id").cast("string").alias("_campaign"))
    with_decision = assessed(df, now).join(found, F.col(key) == F.col("_key"), "left")
    action = F.coalesce("_action", F.lit("new"))
    fresh_id = F.substring(F.sha2(F.concat(F.lit("campaign|"), F.col(key).cast("string")), 256), 1, 16)
    return with_decision.withColumns({
        "labels": gates.labels(F.col("kind"), F.col("country"), F.col("eligibility"), F.col("remote"), F.col("visa")),
        "urgency": urgency(now),
        "action": action,
        "campaign_id": F.when(action == "update", F.col("_campaign")).when(action.isin("new", "new_campaign"), fresh_id),
        "slug": slugs.stem(F.col("company"), F.col("title")),
    }).drop("_key", "_action", "_campaign")
