"""Identity, semantic and discovery keys of vacancies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import texts, urls

# Last path segments that name a list, not a vacancy.
GENERIC_TAILS = (
    "search", "job-search", "jobs-search", "offres", "offres-emploi", "emplois", "openings", "positions", "all-jobs", "all-jobs-search",
    "candidature", "postuler", "application", "applications", "register", "registration", "inscription", "list", "listing", "liste", "annonce", "annonces",
    "jobs", "careers", "career", "vacancies", "apply",
)
# How a document names its reference.
REFERENCE_TEXTS = (
    r"(?i)(?:référence|reference|réf\.?|ref\.?)\s*(?:du\s+concours|de\s+l['’]annonce|de\s+l['’]offre)?\s*[:#№-]?\s*([A-Z0-9][A-Z0-9._/-]{2,40})",
    r"(?:المرجع|رقم\s+(?:المباراة|الإعلان|الاعلان))\s*[:#№-]?\s*([A-Za-z0-9][A-Za-z0-9._/-]{2,40})",
)


def present(c: Column) -> Column:
    """The trimmed text, null where it is blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def is_job_specific(url: Column) -> Column:
    """Whether an address shows one vacancy: a reference in its query, or a last segment that is an id or no generic one.

    A generic last segment is specific after a segment with an id, or after a name deeper in the path.
    """
    named = lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*urls.REFERENCE_KEYS) & (F.char_length(F.substring_index(p, "=", -1)) >= 3)
    has_id = lambda s: s.rlike(r"\d{3,}|[a-f0-9]{8,}")

    def specific(url: Column) -> Column:
        query = F.exists(urls.pairs(url, urls.JOB_TRACKING), named)

        def of_segments(segments: Column) -> Column:
            n = F.size(segments)
            last, parent = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(segments, F.lit(-2)), F.lit(""))
            generic = last.isin(*GENERIC_TAILS)
            deep = (n >= 3) & (parent != "") & ~parent.isin(*GENERIC_TAILS)
            return F.when(n == 0, query).when(generic, has_id(parent) | deep | query).otherwise(has_id(last) | (n >= 2) | query)

        segments = F.filter(F.split(F.lower(urls.path(url)), "/"), lambda s: s != "")
        return F.lower(urls.part(url, 1)).isin("http", "https") & urls.bound(segments, of_segments)

    return urls.bound(url, specific)


def document_reference(pages: Column) -> Column:
    """The first reference that a document's pages name; short numbers are no references."""
    found = F.flatten(F.transform(pages, lambda p: F.array(*(F.regexp_extract(p, r, 1) for r in REFERENCE_TEXTS))))
    bare = F.transform(found, lambda v: F.regexp_replace(v, r"^[ .,:;#-]+|[ .,:;#-]+$", ""))
    return F.coalesce(F.try_element_at(F.filter(bare, lambda v: (v != "") & ~v.rlike("^[0-9]{1,4}$")), F.lit(1)), F.lit(""))


def external_reference(*given: Column, pages: Column | None = None) -> Column:
    """The first reference that is there: row keys, raw keys, the explicit one, the provider's, then the documents'."""
    own = [present(c) for c in given]
    return F.coalesce(*own, *([F.nullif(document_reference(pages), F.lit(""))] if pages is not None else []), F.lit(""))


def core_key(company: Column, title: Column, location: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", *(texts.normalised(blank(c)) for c in (company, title, location)))


def identity_key(reference: Column, company: Column, source: Column, url: Column, apply_url: Column, core: Column) -> Column:
    """Hash of the strongest identity that a row has: reference, own address, application address, core facts."""
    scope = F.coalesce(F.nullif(texts.normalised(company), F.lit("")), texts.normalised(source))
    base = (
        F.when(present(reference).isNotNull(), F.concat(F.lit("ref|"), scope, F.lit("|"), texts.normalised(reference)))
        .when(is_job_specific(url), F.concat(F.lit("url|"), urls.canonical_job(url)))
        .when(is_job_specific(apply_url), F.concat(F.lit("apply|"), urls.canonical_job(apply_url)))
        .otherwise(F.concat(F.lit("core|"), core))
    )
    return F.substring(F.sha2(base, 256), 1, 24)


def semantic_key(core: Column) -> Column:
    return F.substring(F.sha2(core, 256), 1, 20)


def discovery_id(provider: Column, reference: Column, url: Column) -> Column:
    """``provider:reference``, else ``url:address``; one provider's references are labels, so its addresses count alone."""
    name = F.lower(F.coalesce(present(provider), F.lit("")))
    address = urls.canonical(url)
    by_url = F.when(address == "", F.lit("")).otherwise(F.concat(F.lit("url:"), address))
    ref = F.lower(present(reference))
    return F.when((name == "workday") | ref.isNull(), by_url).otherwise(F.concat(F.when(name == "", "source").otherwise(name), F.lit(":"), ref))


def article_id(url: Column) -> Column:
    return texts.stable_hash(urls.canonical(url), 16)


def is_foreign_detail(own: Column, url: Column) -> Column:
    """Whether an address of the same host shows another vacancy: both have references and they differ."""
    differ = urls.bound(urls.reference(own), lambda a: (a != "") & urls.bound(urls.reference(url), lambda b: (b != "") & (a != b)))
    return (urls.host(own) == urls.host(url)) & differ


def same_page(a: Column, b: Column) -> Column:
    """Whether two addresses are one page, their queries apart."""
    return urls.link_key(a) == urls.link_key(b)


def document_key(url: Column) -> Column:
    """A document's address without what differs between its links: query, scheme and case of the host."""
    return F.lower(urls.link_key(url))
