"""URL canonicalisers and predicates as Column expressions.

The canonicalisers differ on purpose: ``canonical`` keeps scheme and parameter order,
``canonical_job`` forces https, drops ``www.`` and sorts parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of tracking parameters of the two canonicalisers.
TRACKING = ("fbclid", "gclid", "dclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "cmpid", "ocid", "spm")
JOB_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "trk", "ref", "source")
# Query keys that name a vacancy.
REFERENCE_KEYS = (
    "id", "job", "jobid", "job_id", "job-id", "requisitionid", "requisition_id", "reqid", "req_id",
    "vacancyid", "vacancy_id", "postingid", "posting_id", "positionid", "position_id", "reference", "ljobid",
)
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where the text is no URL."""
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), PARTS, i)


def host(url: Column) -> Column:
    """Lower-cased authority without ``www.``."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def path(url: Column) -> Column:
    """The path with single slashes and none at its end; ``/`` for none."""
    one = spelled(F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/]*$", ""), "/{2,}", "/"), "/:@!$&'()*+,;=-._~", "/")
    return bound(F.regexp_replace(one, "/+$", ""), lambda bare: F.when(bare == "", F.lit("/")).otherwise(bare))


def spelled(text: Column, safe: str, keep: str = "") -> Column:
    """Percent escapes in one spelling: decoded as UTF-8, then each byte that is no ASCII letter, digit or ``safe`` escaped.

    Texts without escapes, spaces or characters beyond ASCII stay as they are.  What is invalid as UTF-8 becomes the replacement character.
    """

    def escaped(text: Column) -> Column:
        # the decoder of forms takes a plus for a space, and fails on a percent sign that begins no escape
        sound = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        plain = F.coalesce(F.try_url_decode(sound), text)
        marks = "".join(c for c in safe if c not in "-._*")
        out = F.url_encode(plain)  # letters, digits and -._* stay, a space is a plus
        out = F.regexp_replace(F.regexp_replace(out, r"\+", "%20"), r"\*", "*" if "*" in safe else "%2A")
        for c in marks:
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
        return F.when(text.rlike(rf"[^A-Za-z0-9{re.escape(safe)}{keep}]"), out).otherwise(text)

    return bound(text, escaped)


def pairs(url: Column, dropped: tuple[str, ...], prefix: str | None = None) -> Column:
    """``key=value`` pairs of the query without the dropped keys; blank values stay."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    keep = lambda p: (p != "") & ~key(p).isin(*dropped) & (~F.startswith(key(p), F.lit(prefix)) if prefix else F.lit(True))
    full = F.transform(F.split(part(url, 4), "&"), lambda p: F.when((p == "") | F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    return F.transform(F.filter(full, keep), _form)


def _form(pair: Column) -> Column:
    """A pair in the one spelling of forms: escapes decoded and written again, a space as a plus."""
    of = lambda t: F.replace(spelled(F.replace(t, F.lit("+"), F.lit("%20")), "-._~"), F.lit("%20"), F.lit("+"))
    key = F.substring_index(pair, "=", 1)
    return F.when(pair.rlike(r"[^A-Za-z0-9=._~-]"), F.concat(of(key), F.lit("="), of(F.substring(pair, F.char_length(key) + 2, F.char_length(pair))))).otherwise(pair)


def _joined(scheme: Column, authority: Column, where: Column, query: Column) -> Column:
    tail = bound(F.array_join(query, "&"), lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("?"), t)))
    return F.concat(scheme, F.lit("://"), authority, where, tail)


def canonical(url: Column) -> Column:
    """Lower scheme and host, one slash at a time, no fragment, no tracking parameters; other texts trimmed."""

    def formed(url: Column) -> Column:
        made = _joined(F.lower(part(url, 1)), F.lower(part(url, 2)), path(url), pairs(url, TRACKING, "utm_"))
        return F.when(part(url, 1) == "", F.trim(F.coalesce(url, F.lit("")))).otherwise(made)

    return bound(url, formed)


def canonical_job(url: Column) -> Column:
    """https, no ``www.``, sorted parameters without tracking ones; texts other than web addresses trimmed."""

    def formed(url: Column) -> Column:
        made = _joined(F.lit("https"), host(url), path(url), F.array_sort(pairs(url, JOB_TRACKING)))
        return F.when(F.lower(part(url, 1)).isin("http", "https"), made).otherwise(F.trim(F.coalesce(url, F.lit(""))))

    return bound(url, formed)


def link_key(url: Column) -> Column:
    """Host and path alone: the key of the link cache."""
    return F.when(part(url, 1) == "", F.lower(F.trim(F.coalesce(url, F.lit(""))))).otherwise(F.concat(host(url), path(url)))


def reference(url: Column) -> Column:
    """The vacancy's reference: a known query key, else a UUID, else an id in the path."""

    def found(url: Column) -> Column:
        named = F.try_element_at(F.filter(pairs(url, ()), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*REFERENCE_KEYS) & (F.substring_index(p, "=", -1) != "")), F.lit(1))
        return F.coalesce(F.lower(F.substring_index(named, "=", -1)), bound(F.lower(path(url)), in_path))

    def in_path(where: Column) -> Column:
        tries = [
            F.regexp_extract(where, "([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1),
            F.regexp_extract(where, r"/requisition/(\d{2,})(?:/|$)", 1),
            F.regexp_extract(where, r"/jobs?/(\d{3,})(?:/|$)", 1),
            F.regexp_extract(where, r"/offre/(\d{2,})(?:/|$)", 1),
        ]
        return F.coalesce(*(bound(t, lambda x: F.nullif(x, F.lit(""))) for t in tries), F.lit(""))

    return bound(url, found)


def is_specific(url: Column) -> Column:
    """Whether an address shows one item: a reference, or a last path segment with an id or several words."""
    last = lambda where: F.element_at(F.split(where, "/"), -1)
    named = lambda s: s.rlike(r"[0-9]{3,}") | s.rlike(r"[A-Za-z]+-[A-Za-z]+-[A-Za-z]+")
    return bound(url, lambda u: (reference(u) != "") | bound(last(path(u)), named))


def is_likely_article(title: Column, url: Column, site: Column) -> Column:
    """A web address of the site or a sub-domain, with a real title, neither the root nor an asset."""
    own = (host(url) == host(site)) | F.endswith(host(url), F.concat(F.lit("."), host(site)))
    asset = F.lower(path(url)).rlike(r"\.(?:jpe?g|png|gif|svg|webp|css|js|ico|pdf|zip)$")
    return F.lower(part(url, 1)).isin("http", "https") & own & (F.char_length(F.trim(title)) >= 8) & (path(url) != "/") & ~asset
