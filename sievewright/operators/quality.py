"""The gate before publication: ordered rules over a page's markup and its facts, as one Column; the first that a page breaks is its reason.

What other operators decide comes as columns: whether an application's address belongs to the posting, facts that the text lacks
(``facts.missing``), links that no allow-list has (``gates.not_allowed``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ladders, texts, urls
from . import gates

# Phrases of related posts, of the employer's own voice, of promotion, and of a direct link; labels of internal metadata; bounds of a description.
RELATED = ("قد يهمك أيضًا", "قد يهمك أيضا", "مقالات ذات صلة", "مواضيع ذات صلة")
VOICE = r"(?U)(?:\bنبحث\s+عن\b|\bعملائنا\b|\bفريقنا\b|انضم\s+(?:إلينا|لفريقنا))"
PROMOTION = (
    "الشركة الرائدة", "شركة رائدة", "الشركة المرموقة", "فرصة مميزة", "فرصة رائعة", "أحدث معايير", "حماية قصوى", "مهام حيوية", "تحديات مثيرة", "يهم هذا الإعلان فرصة", "يتم الاعتماد في هذا الإعلان على البيانات",
    "تعد هذه الفرصة مناسبة", "تُعد هذه الفرصة مناسبة", "فرصة تستحق الاطلاع", "فرصة توظيف جديدة", "لمزيد من التفاصيل يرجى", "للمزيد من التفاصيل يرجى",
)
DIRECT = ("التقديم المباشر", "رابط التقديم المباشر", "رابط الوظيفة المباشر")
METADATA = r"(?i)(?:تاريخ\s+النشر|تاريخ\s+نشر\s+(?:الإعلان|الوظيفة)|date\s+de\s+publication|publication\s+date|published\s+on|المرجع|الرقم\s+المرجعي|رمز\s+المباراة|r[eé]f(?:[ée]rence)?\.?\s*[:：#-])"
DESCRIPTION = (80, 180)
# Tokens of either script that a text has before it can be mixed; shares and numbers of plain Latin ones that make it so.
LEAST_ARABIC, LEAST_LATIN, PLAIN_SHARE, LEAST_PLAIN, OF_ARABIC = 30, 18, 0.65, 60, 0.6
_ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def visible(html: Column) -> Column:
    """The text of generated markup: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, plain in _ENTITIES.items():
        bare = F.replace(bare, F.lit(name), F.lit(plain))
    return texts.clean(bare)


def attributes(html: Column, tag: str, name: str) -> Column:
    """Values of an attribute of all tags of a kind, in order."""
    pattern = rf"(?is)<{tag}\b[^>]*\b{name}=['\"]([^'\"]+)['\"]"
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1)), lambda v: F.replace(v, F.lit("&amp;"), F.lit("&")))


def table_rows(html: Column) -> Column:
    """Rows of the markup's tables, each an array of its cells' texts."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</?t[hdr]\b|$)"), F.lit(1)), visible))


def is_mixed(text: Column, technical: tuple[str, ...]) -> Column:
    """Whether Latin words that are no terms stand among Arabic ones at random."""
    arabic = F.regexp_count(text, F.lit(r"[؀-ۿ]{2,}"))
    latin = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9+._-]+\b"), F.lit(0))
    plain = F.filter(latin, lambda t: ~F.btrim(F.lower(t), F.lit("._-")).isin(*technical) & ~t.rlike(r"(?i)^(?:CVE-\d{4}-\d+|v?\d+(?:\.\d+)+)$"))
    counts = F.struct(arabic.alias("arabic"), F.size(latin).alias("n"), F.size(plain).alias("m"))
    return urls.bound(counts, lambda c: (c["arabic"] >= LEAST_ARABIC) & (c["n"] >= LEAST_LATIN) & (c["m"] / c["n"] > PLAIN_SHARE) & (c["m"] > LEAST_PLAIN) & (c["m"] > c["arabic"] * OF_ARABIC))


@dataclass(frozen=True)
class Page:
    """The columns that the gate reads; strings unless said."""

    html: Column
    title: Column
    description: Column
    source: Column
    notice: Column
    application: Column
    kind: Column
    #: whether the application's address is bound to this posting (boolean)
    bound: Column
    #: whether an image is expected (boolean), the cover's address, addresses of document pages (array)
    image: Column
    cover: Column
    documents: Column
    #: internal references, facts that the text lacks, links that nothing verifies (arrays)
    references: Column
    lacking: Column
    unverified: Column


def publication_gate(page: Page, technical: tuple[str, ...] = ("api", "cloud", "devops", "java", "linux", "python", "sql", "web")) -> Column:
    """``(passed, reason, words)``: the first rule, in this order, that a page breaks; an empty reason for none.

    The page's columns, its text, links and images are evaluated once for all rules.
    """
    names = [f.name for f in fields(Page)]
    given = F.struct(*(getattr(page, n).alias(n) for n in names))

    def judged(p: Column) -> Column:
        own = Page(**{n: p[n] for n in names})
        read = F.struct(visible(own.html).alias("text"), attributes(own.html, "a", "href").alias("links"), attributes(own.html, "img", "src").alias("images"))
        return urls.bound(read, lambda r: _judged(own, r["text"], r["links"], r["images"], technical))

    return urls.bound(given, judged)


def _judged(page: Page, text: Column, links: Column, images: Column, technical: tuple[str, ...]) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    said = F.concat_ws(" ", page.title, page.description, text)
    has = lambda where, phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(where, p))
    leaked = F.exists(page.references, lambda r: (F.char_length(F.trim(r)) >= 3) & F.contains(F.lower(said), F.lower(F.trim(r))))
    headings = F.transform(F.regexp_extract_all(page.html, F.lit(r"(?is)<h[2-6]\b[^>]*>(.*?)</h[2-6]\s*>"), F.lit(1)), visible)
    keys = F.transform(links, lambda u: F.coalesce(F.nullif(urls.canonical(u), F.lit("://")), u))
    specific, given = urls.is_specific(page.application), ~blank(page.application)
    covered, documents = ~blank(page.cover), F.coalesce(page.documents, F.array().cast("array<string>"))
    rest = F.slice(images, F.lit(2), F.greatest(F.size(images) - 1, F.lit(0)))
    words = texts.word_count(text)
    title = gates.title_problem(page.title, page.notice)
    size = F.char_length(F.trim(page.description))
    reason = ladders.first_of(
        (blank(page.html), "no_html"),
        (blank(page.title), "no_title"),
        (blank(page.description), "no_description"),
        (texts.looks_like_markup(page.html) | texts.looks_like_markup(text), "visible_markup"),
        (texts.has_repeated_blocks(text), "repeated_blocks"),
        (is_mixed(text, technical), "language_mix"),
        (page.image & ~page.html.rlike(r"(?i)<img\b"), "image_missing"),
        (page.html.rlike(r"(?i)<h1\b"), "top_heading"),
        (F.exists(headings, lambda h: gates.repeats_title(page.title, h)), "heading_repeats_title"),
        (page.html.rlike(r"""(?i)class\s*=\s*['"][^'"]*\bpRelate\b"""), "related_block"),
        (has(text, RELATED), "related_text"),
        (page.html.rlike(r"""(?i)<a\b[^>]*\bhref=['"][^'"]*/search/label/[^'"]*['"]"""), "label_link"),
        (page.html.rlike(r"(?i)<script\b"), "script"),
        ((size < DESCRIPTION[0]) | (size > DESCRIPTION[1]), "description_length"),
        (page.description.rlike(VOICE), "employer_voice"),
        (said.rlike(METADATA), "internal_metadata"),
        (F.coalesce(leaked, F.lit(False)), "reference_leak"),
        (has(text, PROMOTION) | has(page.description, PROMOTION), "promotion"),
        (blank(page.source), "no_source"),
        (gates.has_repeated_rows(table_rows(page.html)), "repeated_rows"),
        (F.coalesce(F.size(page.lacking) > 0, F.lit(False)), "fact_missing"),
        (F.coalesce(F.size(page.unverified) > 0, F.lit(False)), "unverified_link"),
        (given & ~F.coalesce(page.bound, F.lit(False)) & ~specific, "portal_unverified"),
        (given & ~F.coalesce(page.bound, F.lit(False)), "other_vacancy"),
        (given & ~specific & ~F.coalesce(page.kind, F.lit("")).isin("official_application_channel", "direct_email"), "portal_unclassified"),
        ((page.kind == "official_application_channel") & has(text, DIRECT), "channel_called_direct"),
        (title != "", "title_style"),
        (texts.has_twice(keys), "link_twice"),
        (covered & ~F.coalesce(F.get(images, F.lit(0)) == page.cover, F.lit(False)), "cover_not_first"),
        (F.when(covered, rest != documents).otherwise((F.size(documents) > 0) & (images != documents)), "document_pages"),
    )
    return urls.bound(reason, lambda r: F.struct((r == "").alias("passed"), r.alias("reason"), words.alias("words")))
