"""Records of listing pages: one row for each card, with its link and the facts that the card itself states.

Adapters are tables of rules and Column expressions over ``operators.cards``; no fact is taken from another card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts, urls
from ..operators import cards, tables
from .readers import resolve

# An adapter's host (null: the page's own), path of a detail page with its reference, least title length, elements of a card, provider.
ADAPTERS: dict[str, dict] = {
    "tanmia": {"host": "tanmia.ma", "path": r"^/(\d{2}-\d{2}-20\d{2})/\d+/?$", "title": 8, "card": (), "provider": ""},
    "ofppt": {"host": "recrutement.ofppt.ma", "path": r"(?i)^/offre/(\d+)/?$", "title": 5, "card": (), "provider": ""},
    "accor": {"host": "careers.accor.com", "path": r"(?i)^/global/en/job/[^/]+-jid-(\d+)$", "title": 8, "card": (), "provider": ""},
    "emploi_public": {"host": "emploi-public.ma", "path": r"(?i)(?:/ar/تفاصيل/المباريات/|/fr/concours/details/)([0-9a-fA-F-]{8,}|[^/?#]+)/?$", "title": 8, "card": ("article", "li", "tr", "section", "div"), "provider": "emploi_public"},
    "alten": {"host": "alten.ma", "path": r"^/jobs/(\d{8,})-[^/]+/?$", "title": 8, "card": (), "provider": "alten"},
    "inwi": {"host": None, "path": r"(?i)^/jobs/(\d+)-[^/]+/?$", "title": 1, "card": ("article", "li", "section", "div"), "provider": "teamtailor"},
    "credit_du_maroc": {"host": None, "path": r"(?i)^/offre-de-emploi/emploi-[^/]+_(\d+)\.aspx/?$", "title": 1, "card": ("li", "article", "tr", "section", "div"), "provider": "credit_du_maroc"},
}
# Link texts that name nothing; months of the public service's listing.
GENERIC = ("تفاصيل", "التفاصيل", "عرض التفاصيل", "voir", "voir détails", "voir details", "détails", "details")
MONTHS = {"يناير": 1, "فبراير": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "ماي": 5, "مايو": 5, "يونيو": 6, "يوليوز": 7, "يوليو": 7, "غشت": 8, "شتنبر": 9, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نونبر": 11, "نوفمبر": 11, "دجنبر": 12, "ديسمبر": 12}
# Labels of links to the following page, marks of the paths that load more.
NEXT_LABELS = (
    "next", "next page", "suivant", "page suivante", "suivante", "load more", "show more", "view more", "see more", "afficher plus", "voir plus", "charger plus",
    "التالي", "الصفحة التالية", "أظهر المزيد", "اظهر المزيد", "عرض المزيد", "المزيد",
)
NEXT_PATHS = ("loadcards", "load-more", "load_more", "loadmore", "show_more")
# Scores of where a link stands.
PLACES = ((("article", "h1"), 10), (("article", "h2"), 9), (("article", "h3"), 8), (("main", "h1"), 8), (("main", "h2"), 7), (("main", "h3"), 6), (("article",), 4), (("main",), 3))


def anchors(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(page_url, position, link, cards, title, url)`` of each link of ``pages``, in order."""
    found = cards.linked(pages.select(F.col(url_col).alias("page_url"), F.col(html_col).alias("_html")), "_html")
    rows = found.select("page_url", "cards", F.posexplode("links").alias("position", "link"))
    return rows.select("page_url", "position", "link", cards.own_cards(F.col("link"), F.col("cards")).alias("cards"), texts.clean(F.col("link.label")).alias("title"), resolve(F.col("page_url"), F.col("link.href")).alias("url"))


def _date(day: Column, month: Column, year: Column) -> Column:
    """An ISO date, null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd").cast("string")


def _numeric(text: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), _date(part(1), part(2), part(3)))


def public_deadline(text: Column) -> Column:
    """The last day that a card of the public service's listing names."""
    pattern = r"آخر\s+أجل\s+لإيداع\s+ملفات\s+الترشيح\s*:?\s*(\d{1,2})\s+([؀-ۿ]+)\s+(\d{4})"
    months = F.create_map(*(F.lit(x) for m, n in MONTHS.items() for x in (m, str(n))))
    month = F.try_element_at(months, F.regexp_extract(text, pattern, 2))
    return F.when(month.isNotNull(), _date(F.regexp_extract(text, pattern, 1), month, F.regexp_extract(text, pattern, 3)))


def _head(card: Column, *tags: str) -> Column:
    return F.get(F.transform(F.filter(card["heads"], lambda h: h["tag"].isin(*tags)), lambda h: texts.clean(h["text"])), F.lit(0))


def _first_title(candidates: list[Column], least: int) -> Column:
    good = F.filter(F.array(*candidates), lambda t: t.isNotNull() & (F.char_length(t) >= least) & ~F.lower(t).isin(*GENERIC))
    return F.get(good, F.lit(0))


RECORD = ("title", "url", "provider", "reference", "deadline", "published_at", "company")


def records(pages: DataFrame, url_col: str, html_col: str, adapter: str, today: Column) -> DataFrame:
    """``(page_url, position, title, url, provider, reference, deadline, published_at, company)`` of the detail links that an adapter knows, the first of
    an address, in the page's order; expired cards are left out where the listing says that they are."""
    rule = ADAPTERS[adapter]
    own = urls.host(F.col("page_url")) if rule["host"] is None else F.lit(rule["host"])
    path = urls.path(F.col("decoded")) if adapter == "emploi_public" else urls.path(F.col("url"))
    found = anchors(pages, url_col, html_col).filter("link.tag = 'a'")
    if adapter == "tanmia":  # the first link of a heading
        found = found.filter(cards.within(F.col("link"), "h2", "h3", "h4")).withColumn("heading", F.col("link.heading"))
        found = tables.keep_first(found, ["page_url", "heading"], "position")
    found = found.withColumn("decoded", F.coalesce(F.try_url_decode(F.replace("url", F.lit("+"), F.lit("%2B"))), "url"))
    found = found.withColumn("reference", F.regexp_extract(path, rule["path"], 1)).filter((urls.host(F.col("url")) == own) & (F.col("reference") != ""))
    none = F.lit(None).cast("string")
    card = cards.nearest(F.col("cards"), *rule["card"]) if rule["card"] else F.get(F.col("cards"), F.lit(0))
    found = found.withColumn("card", card).withColumn("text", texts.clean(F.coalesce("card.text", "title")))
    fields: dict[str, Column] = {"deadline": none, "published_at": none, "company": none, "title": F.col("title"), "url": F.col("url"), "reference": F.col("reference")}
    if adapter == "tanmia":
        day = F.split("reference", "-")
        fields |= {"published_at": _date(day[0], day[1], day[2]), "reference": F.lit("")}
        found = found.filter(fields["published_at"].isNotNull())
    elif adapter == "ofppt":
        box = F.get(F.filter("cards", lambda c: (c["tag"] == "article") & F.array_contains(F.split(c["marks"], r"\s+"), "offer-box")), F.lit(0))
        stated = texts.clean(F.coalesce(box["text"], F.lit("")))
        deadline = _numeric(F.regexp_extract(stated, r"(?i)(?:Date\s+d[’']?\s*expiration|Dernier\s+D[ée]lai)\s*:\s*([0-9][0-9./-]{6,})", 1), r"(?<![0-9])(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?![0-9])")
        expired = F.coalesce(deadline < F.date_format(today, "yyyy-MM-dd"), F.lit(False)) | F.concat_ws(" ", stated, F.col("title")).rlike(r"(?i)expir[ée]e?(?!\p{L})")
        said = F.regexp_extract(stated, r"(?i)R[ée]f[ée]rence\s*:\s*(.+?)(?=\s+Date\s+d[’']?\s*expiration|\s*$)", 1)
        fields |= {"title": F.regexp_replace("title", r"(?i)\s*\(\s*expir[ée]e?\s*\)\s*$", ""), "deadline": deadline, "reference": said}
        found = found.filter(~expired)
    elif adapter == "emploi_public":
        fields |= {"title": _first_title([F.col("title"), *(_head(F.col("card"), t) for t in cards.HEADS)], rule["title"]), "url": F.concat(F.lit("https://www.emploi-public.ma"), F.regexp_replace(urls.path(F.col("url")), "/+$", "")), "deadline": public_deadline(F.col("text"))}
    elif adapter == "alten":
        # the cards that hold this vacancy alone, inside out; the first that has a date
        alone = lambda c: F.size(F.array_distinct(F.filter(c["hrefs"], lambda h: h.rlike(r"/jobs/\d{8,}-")))) <= 1
        dated = F.get(F.filter("cards", lambda c: alone(c) & c["text"].rlike(r"\b\d{2}/\d{2}/\d{4}\b")), F.lit(0))
        fields |= {"published_at": _numeric(dated["text"], r"\b(\d{2})/(\d{2})/(\d{4})\b"), "company": F.lit("ALTEN MAROC")}
    elif adapter == "inwi":
        fields |= {"title": _first_title([F.col("title"), _head(F.col("card"), "h1", "h2", "h3", "h4")], 1)}
    elif adapter == "credit_du_maroc":
        said = F.regexp_extract("text", r"(?i)(?:Réf(?:érence)?\.?\s*:?\s*)(\d{4}-\d+)", 1)
        fields |= {"title": _first_title([F.col("title"), _head(F.col("card"), "h1", "h2", "h3", "h4")], 1), "reference": F.coalesce(F.nullif(said, F.lit("")), "reference"), "published_at": _numeric(F.col("text"), r"\b(\d{2})/(\d{2})/(\d{4})\b")}
    shaped = found.select("page_url", "position", F.lit(rule["provider"]).alias("provider"), *(c.alias(n) for n, c in fields.items()))
    named = shaped.filter(F.coalesce(F.char_length("title"), F.lit(0)) >= rule["title"]).withColumn("_key", urls.canonical(F.col("url")))
    return tables.keep_first(named, ["page_url", "_key"], "position").select("page_url", "position", *RECORD)


def article_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(page_url, title, url, score)`` of the likely articles of any page: links in articles first, then in headings, then the others; the best of an address."""
    link = F.col("link")
    place = F.coalesce(*(F.when(F.reduce(F.array(*(cards.within(link, t) for t in where)), F.lit(True), lambda a, b: a & b), score) for where, score in PLACES), F.lit(1))
    more = F.when(cards.within(link, "article"), 2).otherwise(0) + F.when(cards.within(link, "h1", "h2", "h3"), 2).otherwise(0)
    found = anchors(pages, url_col, html_col).filter("link.tag = 'a'").withColumn("score", place + more)
    kept = found.filter(urls.is_likely_article(F.col("title"), F.col("url"), F.col("page_url")))
    return tables.keep_first(kept, ["page_url", "url"], F.desc("score"), "position").select("page_url", "title", "url", "score")


def next_pages(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(page_url, next_url)``: the first link that says that it leads on, by relation, label or path, or else to the page of the next number; of the
    same host and not the page itself.  Pages without one are left out."""
    found = anchors(pages, url_col, html_col)
    link, url, page = F.col("link"), F.col("url"), F.col("page_url")
    label = F.lower(F.concat_ws(" ", link["label"], link["aria"], link["hint"]))
    says = F.array_contains(F.split(link["rel"], r"\s+"), "next") | F.exists(F.array(*map(F.lit, NEXT_LABELS)), lambda x: F.contains(label, x)) | F.lower(urls.path(url)).rlike("|".join(NEXT_PATHS))
    number = lambda u: F.coalesce(F.regexp_extract(u, r"[?&]page=([0-9]+)(?:[&#]|$)", 1).try_cast("int"), F.lit(0))
    bare = lambda u: F.regexp_replace(urls.path(u), "/+$", "")
    counts = url.rlike(r"[?&]page=[0-9]+(?:[&#]|$)") & (bare(url) == bare(page)) & (number(url) == number(page) + 1) & (link["tag"] == "a")
    rank = F.when(says, 0).when(counts, 1)
    same = (F.lower(urls.part(url, 2)) == F.lower(urls.part(page, 2))) & (urls.canonical(url) != urls.canonical(page))
    kept = found.withColumn("rank", rank).filter(F.col("rank").isNotNull() & same)
    return tables.keep_first(kept, ["page_url"], "rank", "position").select("page_url", F.col("url").alias("next_url"))
