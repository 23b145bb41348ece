"""Gates, policies and maintenance over queue rows: filters, ladders, lookups.

Rules are data: ordered ``(condition, label)`` pairs, so a gate is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders, texts, times, urls
from . import tables

# Subsets and splits


def prefer(df: DataFrame, flag: Column, by: list[str] | None = None) -> DataFrame:
    """Rows of the preferred subset of each group, or all rows of groups that have none."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    if by is None:
        has = marked.agg(F.coalesce(F.bool_or("_flag"), F.lit(False)).alias("_any"))
        return marked.join(F.broadcast(has)).filter("_flag or not _any").drop("_flag", "_any")  # one row
    has = marked.groupBy(*by).agg(F.bool_or("_flag").alias("_any"))
    return marked.join(has, by).filter("_flag or not _any").drop("_flag", "_any")


def cooldown_split(df: DataFrame, until: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Healthy rows, and those whose cool-down has not ended."""
    waiting = F.coalesce(F.col(until) > now, F.lit(False))
    return df.filter(~waiting), df.filter(waiting)


def selectable(status: Column, archived: Column, fetched: Column, retry: list[Column], now: Column) -> Column:
    """Whether a queue row can be selected: ready, fetched, with no retry clock in the future."""
    clear = F.lit(True)
    for at in retry:
        clear = clear & F.coalesce(at <= now, F.lit(True))
    return ~F.coalesce(archived, F.lit(False)) & status.isin("ready", "selected") & F.coalesce(fetched, F.lit(False)) & clear


# Lookups


def any_key_lookup(left: DataFrame, right: DataFrame, left_id: str, keys: list[tuple[str, str]], right_id: str) -> DataFrame:
    """``(left_id, right_id)``: the match by the first key that has one, the smallest id of several.

    One equi-join a key and a union, not a join on an OR, which could only be nested loops.
    """
    found = None
    for rank, (own, theirs) in enumerate(keys):
        a = left.select(F.col(left_id).alias("_l"), F.col(own).alias("_k")).filter("_k is not null and cast(_k as string) <> ''")
        # the smallest id of each key, so that no row meets all of a frequent one
        b = right.groupBy(F.col(theirs).alias("_k")).agg(F.min(right_id).alias("_r"))
        met = a.join(b, "_k").select("_l", F.struct(F.lit(rank).alias("rank"), "_r").alias("m"))
        found = met if found is None else found.union(met)
    return found.groupBy("_l").agg(F.min("m").alias("m")).select(F.col("_l").alias(left_id), F.col("m._r").alias(right_id))


def not_allowed(df: DataFrame, links: Column, allowed: Column) -> Column:
    """Links of a row that its allow-list lacks, canonicalised on both sides."""
    key = lambda a: F.transform(a, urls.canonical)
    return F.array_except(key(links), key(allowed))


# Repetition


def repeated_blocks(blocks: DataFrame, doc: str, position: str, region: str, text: str, atoms: str = r"[0-9][0-9./:-]*[0-9]", categories: dict[str, str] | None = None) -> DataFrame:
    """Pairs of a document's blocks in different regions that say the same: ``(doc, left, right, shared)``.

    Blocks of at least four words; shared four and 0.84 of the smaller and 0.55 of all; or 0.65 of the smaller with a shared
    *atom* (a number or date); or three shared and 0.55 of the smaller with a shared category. The join is on
    document and word, so unrelated blocks never meet; its rows are words alone, and atoms and categories are met by the pairs that share enough.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))
    numbers = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(atoms), F.lit(0)))
    kinds = F.array_compact(F.array(*(F.when(F.lower(text).rlike(pattern), F.lit(name)) for name, pattern in (categories or {}).items()))).cast("array<string>")
    sets = blocks.select(doc, position, region, words.alias("w"), numbers.alias("atoms"), kinds.alias("kinds")).filter(F.size("w") >= 4)
    posted = sets.select(doc, position, region, F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = posted.alias("a"), posted.alias("b")
    met = a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.word") == F.col("b.word")) & (F.col(f"a.{position}") < F.col(f"b.{position}")) & (F.col(f"a.{region}") != F.col(f"b.{region}")))
    keys = [F.col(f"a.{doc}").alias(doc), F.col(f"a.{position}").alias("left"), F.col(f"b.{position}").alias("right"), F.col(f"a.{region}").alias("_lr"), F.col(f"b.{region}").alias("_rr")]
    counted = met.groupBy(*keys).agg(F.count("*").alias("shared"), F.first("a.n").alias("n"), F.first("b.n").alias("m"))
    enough = counted.filter(F.col("shared") / F.least("n", "m") >= 0.55)  # the least that any rule asks for
    side = lambda at, where, name: sets.select(doc, F.col(position).alias(at), F.col(region).alias(where), F.struct("atoms", "kinds").alias(name))
    shared = enough.join(side("left", "_lr", "l"), [doc, "left", "_lr"]).join(side("right", "_rr", "r"), [doc, "right", "_rr"]).withColumns({"atom": F.arrays_overlap("l.atoms", "r.atoms"), "kind": F.arrays_overlap("l.kinds", "r.kinds")})
    part, all_ = F.col("shared") / F.least("n", "m"), F.col("n") + F.col("m") - F.col("shared")
    same = (F.col("shared") >= 4) & (part >= 0.84) & (F.col("shared") / all_ >= 0.55)
    says = F.coalesce(F.col("atom"), F.lit(False)) & (part >= 0.65) | F.coalesce(F.col("kind"), F.lit(False)) & (F.col("shared") >= 3) & (part >= 0.55)
    return shared.filter(same | says).select(doc, "left", "right", "shared")


def has_repeated_rows(rows: Column) -> Column:
    """Whether a table has a row twice, apart from case and punctuation."""
    prints = F.filter(F.transform(rows, lambda r: F.regexp_replace(F.lower(F.array_join(r, " ")), r"[^\p{L}\p{N}]+", "")), lambda p: p != "")
    return texts.has_twice(prints)


# Policies


def qualification(evidence: Column, above: str, level: str, below: str) -> Column:
    """The strongest statement of an array of texts: above the limit, at it, below it, else unverified."""
    says = lambda pattern: F.exists(evidence, lambda e: e.rlike(pattern))
    return ladders.first_of((says(above), "above_limit"), (says(level), "at_limit"), (says(below), "below_limit"), otherwise="unverified")


def application_policy(url: Column, email: Column, site: Column, verified: Column) -> Column:
    """Why an application channel is refused; empty for a good one."""
    return ladders.first_of(
        ((F.coalesce(F.trim(url), F.lit("")) == "") & (F.coalesce(F.trim(email), F.lit("")) == ""), "no_channel"),
        ((F.coalesce(F.trim(url), F.lit("")) == "") & ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "bad_email"),
        ((F.coalesce(F.trim(url), F.lit("")) != "") & (urls.part(url, 1) == ""), "bad_address"),
        ((urls.host(url) == urls.host(site)) & (urls.path(url) == "/"), "front_page"),
        ((urls.host(url) != urls.host(site)) & ~F.coalesce(verified, F.lit(False)), "foreign_channel"),
    )


def quality_gate(title: Column, body: Column, least_words: int = 40, most_title: int = 120) -> Column:
    """``(passed, reason, words)``: the first rule that a text breaks."""
    words = texts.word_count(body)
    reason = ladders.first_of(
        (texts.clean(title) == "", "no_title"),
        (F.char_length(title) > most_title, "long_title"),
        (words < least_words, "short_text"),
        (texts.looks_like_markup(body), "visible_markup"),
        (texts.has_repeated_blocks(body), "repeated_blocks"),
        (F.contains(F.lower(body), F.lit("lorem ipsum")), "placeholder"),
    )
    return F.struct((reason == "").alias("passed"), reason.alias("reason"), words.alias("words"))


def copy_problems(text: Column, earlier: Column, most: int = 600, lines: int = 12, emoji: int = 6) -> Column:
    """What is wrong with a short promotional text."""
    hook = F.substring_index(F.trim(text), "\n", 1)
    return ladders.reasons(
        (F.char_length(text) > most, "too_long"),
        (F.size(F.split(F.trim(text), "\n")) > lines, "too_many_lines"),
        (F.regexp_count(text, F.lit(r"[\x{1F300}-\x{1FAFF}]")) > emoji, "too_many_emoji"),
        (F.array_contains(F.transform(earlier, lambda e: texts.clean(F.lower(e))), texts.clean(F.lower(hook))), "hook_used_before"),
        (texts.looks_like_markup(text), "visible_markup"),
    )


# Memory, rotation, pacing


def recency(old: DataFrame, new: DataFrame, by: str, key: str, position: str, most: int) -> DataFrame:
    """A bounded memory, newest first: new keys by position, then old ones by theirs, each key once."""
    both = new.select(by, key, position, F.lit(0).alias("_old")).union(old.select(by, key, position, F.lit(1)))
    once = tables.keep_first(both, [by, key], "_old", position)
    return tables.top_k(once, [by], most, "_old", position, key, rank="place").drop("_old", position)


def least_used(choices: DataFrame, uses: DataFrame, choice: str, salt: Column) -> DataFrame:
    """The choice that was used least, ties by a hash of the salt."""
    counted = tables.zero_filled(choices, uses.withColumnRenamed(choice, "_used"), choice, "_used")
    return counted.orderBy("n", F.sha2(F.concat_ws("|", choice, salt), 256)).limit(1)


def rotation(df: DataFrame, by: list[str], labels: tuple[str, ...], *order: Column | str) -> DataFrame:
    """Labels by turns."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("label", F.array(*map(F.lit, labels))[turn % len(labels)])


def spacing(df: DataFrame, by: list[str], at: str, minutes: int, tie: str) -> DataFrame:
    """Add ``minutes_since`` the group's previous row and whether that is far enough."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at, tie))
    since = F.floor((times.micros(F.col(at)) - times.micros(before)) / 60_000_000)
    return df.withColumn("minutes_since", since).withColumn("allowed", F.coalesce(since >= minutes, F.lit(True)))


def delivery_state(posted: Column, uncertain: Column, failures: Column, expired: Column, comment_failed: Column) -> Column:
    return ladders.first_of((posted & comment_failed, "comment_failed"), (posted, "posted"), (expired, "expired"), (uncertain, "uncertain"), (failures >= 5, "failed"), otherwise="pending")


def maintained(status: Column, anchor: Column, published: Column, now: Column, limit_hours: Column) -> Column:
    """What maintenance does with a queue row: ``archive`` with its reason, ``release`` a stale lock, or ``keep``."""
    hours = (times.micros(now) - times.micros(anchor)) / 3_600_000_000
    return ladders.first_of(
        (status.isin("skipped", "failed") & (hours > 168), "archive_old"),
        (~published & (hours > F.greatest(F.lit(24), F.when(limit_hours > 24, limit_hours + 24).otherwise(limit_hours))), "archive_expired"),
        ((status == "selected") & (hours * 60 >= 30), "release"),
        otherwise="keep",
    )


def pruned(pointers: DataFrame, campaigns: DataFrame, key: str) -> DataFrame:
    """Pointers whose campaign is still there."""
    return pointers.join(campaigns.select(key).distinct(), key, "left_semi")


# Eligibility


def retry_after(fields: list[Column]) -> Column:
    """The latest of a row's retry clocks."""
    return F.greatest(*fields) if len(fields) > 1 else fields[0]


def in_recent_failure(fields: list[Column], now: Column) -> Column:
    return F.coalesce(retry_after(fields) > now, F.lit(False))


def is_rolling(kind: Column, official: Column, verified: Column, proof: Column) -> Column:
    """An open-ended application that is proved: no missing deadline counts as one."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return kind.isin("internship", "training", "apprenticeship") & yes(official) & yes(verified) & (F.coalesce(F.trim(proof), F.lit("")) != "")


def publication_policy(deadline: Column, rolling: Column, qualification_: Column, now: Column) -> Column:
    """``(passed, reasons, permanent_reject)``: the closed gates before a publication."""
    over, above = F.coalesce(deadline <= now, F.lit(False)), qualification_ == "above_limit"
    found = ladders.reasons((deadline.isNull() & ~F.coalesce(rolling, F.lit(False)), "no_deadline"), (over, "deadline_passed"), (above, "over_qualified"))
    return F.struct((F.size(found) == 0).alias("passed"), found.alias("reasons"), (over | above).alias("permanent_reject"))


def is_fresh_candidate(status: Column, archived: Column, deadline: Column, now: Column, statuses: tuple[str, ...] = ("ready", "selected")) -> Column:
    """An open row whose deadline, if it has one, has not passed."""
    return status.isin(*statuses) & ~F.coalesce(archived, F.lit(False)) & F.coalesce(deadline >= now, F.lit(True))


def is_publishable(status: Column, processing: Column, ai_status: Column, quality: Column, provider: Column, fallback: Column, html: Column) -> Column:
    """Whether a finished article may be published: each stage passed, by a real provider, with a body."""
    name = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    done = status.isin("selected", "draft_created", "published") & (processing == "ready_for_ai") & (ai_status == "completed") & (quality == "passed")
    return F.coalesce(done, F.lit(False)) & (name != "") & ~F.startswith(name, F.lit("deterministic:")) & ~F.coalesce(fallback, F.lit(False)) & (F.coalesce(html, F.lit("")) != "")


def is_social_candidate(passed: Column, live: Column, post_id: Column, expired: Column, status: Column, retry_at: Column, now: Column) -> Column:
    """Whether a published row may be posted: not posted, not expired, pending or failed with its clock run out."""
    return passed & live & (F.coalesce(post_id, F.lit("")) == "") & ~F.coalesce(expired, F.lit(False)) & status.isin("facebook_pending", "failed") & F.coalesce(retry_at <= now, F.lit(True))


def social_retry_pending(published: Column, status: Column, post_id: Column, comment_id: Column) -> Column:
    """A published row whose delivery has not come to an end."""
    ended = (status == "facebook_expired") | ((status == "posted") & (F.coalesce(post_id, F.lit("")) != "") & (F.coalesce(comment_id, F.lit("")) != ""))
    return F.coalesce(published, F.lit(False)) & ~F.coalesce(ended, F.lit(False))


def is_enriched_enough(words: Column, chars: Column, status: Column, least_words: int = 120, least_chars: int = 700) -> Column:
    """Whether a cached text spares another fetch."""
    return F.coalesce((status == "success") & (words >= least_words) & (chars >= least_chars), F.lit(False))


def enrichment_status(chars: Column, words: Column, strong: tuple[int, int] = (1_200, 180), weak: tuple[int, int] = (300, 40)) -> Column:
    """``strong``, ``weak`` or ``failed`` by characters and words."""
    at = lambda least: (F.coalesce(chars, F.lit(0)) >= least[0]) & (F.coalesce(words, F.lit(0)) >= least[1])
    return ladders.first_of((at(strong), "strong"), (at(weak), "weak"), otherwise="failed")


# What marks noise, navigation and paid links.
NOISE = r"cookie|newsletter|subscribe|advertis|sign in|log in|share this|all rights reserved"
AFFILIATE = r"(?:^|[?&])(?:aff|affid|affiliate|partner|tag|clickid)=|/(?:aff|go|out|redirect)/"


def is_noise(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(NOISE)


def is_affiliate(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(AFFILIATE)


def is_trusted(url: Column, site: Column, trusted: tuple[str, ...]) -> Column:
    """An address of another site than the page's, among the trusted ones or their sub-domains."""
    host = urls.host(url)
    ours = F.lit(False)
    for t in trusted:
        ours = ours | (host == t) | F.endswith(host, F.lit(f".{t}"))
    return ours & (host != urls.host(site))


def trusted_references(links: DataFrame, by: str, position: str, url: str, site: str, trusted: tuple[str, ...], most: int = 5) -> DataFrame:
    """The first distinct trusted links of each page, tracking taken off."""
    kept = links.filter(is_trusted(F.col(url), F.col(site), trusted) & ~is_affiliate(F.col(url))).withColumn(url, urls.canonical(F.col(url)))
    return tables.top_k(tables.keep_first(kept, [by, url], position), [by], most, position)


# Titles


def fact_tokens(text: Column) -> Column:
    """A text's distinct words of three or more letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))


def repeats_title(title: Column, heading: Column, least: float = 0.9) -> Column:
    """Whether a heading says the title again: four words or more each, nine tenths of the smaller shared."""
    a, b = fact_tokens(title), fact_tokens(heading)
    n = F.least(F.size(a), F.size(b))
    return F.when(n < 4, False).otherwise(F.size(F.array_intersect(a, b)) / n >= least)


# What a title of a notice's type must say.
TITLE_HINTS = {
    "candidate_list": r"لائحة|لوائح|مدعو|convoqu|shortlist|list", "final_results": r"نهائي|définitif|final", "results": r"نتائج|نتيجة|résultat|result",
    "competition": r"مباراة|مباريات|concours|competition", "vacancy": r"توظيف|وظيف|تشغيل|recrut|offre|emploi|poste|hiring|job|vacanc|stage|intern",
}


def title_problem(title: Column, notice: Column) -> Column:
    """The first style rule that a title breaks; empty for a good one."""
    plain = texts.clean(title)
    says = F.lit(True)
    for kind, hints in TITLE_HINTS.items():
        says = F.when(notice == kind, F.lower(plain).rlike(hints)).otherwise(says)
    return ladders.first_of(
        (F.char_length(plain) < 28, "too_short"),
        (F.char_length(plain) > 150, "too_long"),
        (F.size(fact_tokens(plain)) < 4, "unspecific"),
        (~says, "type_not_named"),
        (plain.rlike(r"(?i)https?://|www\."), "has_address"),
        (plain.rlike(r"(?i)(?<!@)\b[a-z0-9][a-z0-9.-]*\.(?:ma|com|org|net|fr)\b"), "has_domain"),
        (plain.rlike(r"(?i)\bSi[eè]ge\b"), "page_layout"),
    )


def labels(kind: Column, country: Column, eligibility: Column, remote: Column, visa: Column) -> Column:
    """A posting's labels in order, each once."""
    plural = F.create_map(*map(F.lit, ("internship", "internships", "scholarship", "scholarships", "training", "training", "apprenticeship", "apprenticeships")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    said = F.lower(F.trim(F.coalesce(eligibility, F.lit(""))))
    where = F.when((F.upper(F.coalesce(country, F.lit(""))) == "MA") | (said == "morocco"), "jobs-morocco").when(yes(remote) | (said == "remote_morocco"), "remote-jobs").otherwise("jobs-abroad")
    return F.array_distinct(F.array_compact(F.array(F.lit("jobs"), F.try_element_at(plural, kind), where, F.when(yes(visa) | (said == "visa_confirmed"), F.lit("visa-sponsorship")))))


def retired(df: DataFrame, sources: DataFrame, name: str, published: Column) -> DataFrame:
    """Rows of retired sources, by name in any case, those that are published left out."""
    gone = sources.select(F.lower(F.trim(name)).alias("_gone")).filter("_gone <> ''").distinct()
    return df.filter(~F.coalesce(published, F.lit(False))).join(gone, F.lower(F.trim(F.col(name))) == F.col("_gone"), "left_semi")


# Rankings


def fresh_order(published: Column, discovered: Column, url: Column) -> list[Column]:
    """The queue's order: publication, unknown ones first; discovery, unknown ones last; address."""
    return [published.asc_nulls_first(), discovered.asc_nulls_last(), url.asc()]


def source_priority(name: Column, hints: tuple[str, ...]) -> Column:
    """The place of the first hint that a source's name has; after them names of the general kind, then all others."""
    folded = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(folded.rlike("ai|tool"), len(hints)).otherwise(len(hints) + 1)
    for i in range(len(hints) - 1, -1, -1):
        out = F.when(F.contains(folded, F.lit(hints[i])), i).otherwise(out)
    return out


def source_order(last: Column, name: Column, url: Column, hints: tuple[str, ...]) -> list[Column]:
    """Least recently crawled first, never crawled before all; then by the name's priority; then address."""
    return [last.asc_nulls_first(), source_priority(name, hints).asc(), url.asc()]
