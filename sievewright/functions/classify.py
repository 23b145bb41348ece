"""Classifiers: ordered tables of patterns, the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ladders, texts

# Signs of a failure's category, in order.
ERRORS = (
    ("auth", r"401|403|unauthorized|forbidden|invalid api key|invalid key"),
    ("quota", r"429|402|quota|rate limit|rate-limit|rate_limited|resource_exhausted|too many requests"),
    ("outage", r"500|502|503|504|service unavailable|temporarily unavailable"),
    ("timeout", r"timeout|timed out|deadline exceeded"),
    ("empty", r"empty response|returned empty|no content"),
    ("cooldown", r"cooling down|cooldown"),
    ("config", r"missing key|no ai provider key"),
)
# Signs of a notice's type, in order; the title's outrank the body's.
NOTICES = (
    ("final_results", r"النتائج\s+النهائية|نتائج\s+نهائية|résultats?\s+définitifs?|final\s+results?"),
    ("candidate_list", r"لوائح?\s+المدعوين|لائحة\s+المدعوين|convoqu[eé]s?|shortlist|admis.*(?:écrit|oral)|مدعوين.*(?:كتابي|شفوي)"),
    ("results", r"النتائج|النتيجة|résultats?|results?"),
    ("competition", r"مباراة|مباريات|concours|recrutement\s+par\s+concours"),
)
NOTICE_STATUS = (("provisional", r"مؤقتة|مؤقت|أولية|provisoire|provisional|préliminaire|preliminaire"), ("final", r"نهائية|نهائي|définitive|definitive|finale|final"))
# Families of words of the focus.
CYBER = r"\bcyber|\bsecurity\b|\bsécurité\s+informatique\b|\bpentest|\bsoc\b|أمن\s+(?:المعلومات|سيبراني)"
TECH = r"\bsoftware\b|\bd[eé]velopp|\bdeveloper\b|\bdata\b|\bcloud\b|\bdevops\b|\binformatique\b|\bintelligence\s+artificielle\b|\bartificial\s+intelligence\b|\b(?:sap|erp|salesforce|servicenow)\b|معلوماتية|شبكات|بيانات"
STUDENT = r"\bstage\b|\bstagiaire\b|\binternship\b|\bintern\b|\balternance\b|\bapprentissage\b|\bpfe\b|تدريب|متدرب|متدربة|تداريب"
# Schema values of employment types, in order of their hints.
EMPLOYMENT = (
    ("FULL_TIME", ("full time", "full-time", "temps plein", "دوام كامل")),
    ("PART_TIME", ("part time", "part-time", "temps partiel", "دوام جزئي")),
    ("INTERN", ("internship", "intern", "stage", "stagiaire", "تدريب")),
    ("TEMPORARY", ("temporary", "temporaire", "intérim", "interim", "cdd", "مؤقت")),
    ("CONTRACTOR", ("contractor", "freelance", "consultant indépendant", "independent contractor")),
    ("VOLUNTEER", ("volunteer", "bénévole", "benevole", "تطوع")),
    ("PER_DIEM", ("per diem", "journalier", "يومي")),
)
SCHEMA_TYPES = ("FULL_TIME", "PART_TIME", "CONTRACTOR", "TEMPORARY", "INTERN", "VOLUNTEER", "PER_DIEM", "OTHER")
CURRENCIES = (("MAD", ("mad", "dhs", "dh", "درهم", "د.م")), ("EUR", ("eur", "€", "euro")), ("USD", ("usd", "$", "dollar")), ("GBP", ("gbp", "£", "pound")))
CITIES = (
    "Casablanca", "Rabat", "Salé", "Sale", "Marrakech", "Marrakesh", "Fès", "Fes", "Tanger", "Tangier", "Agadir", "Meknès", "Meknes", "Oujda", "Kénitra", "Kenitra",
    "Tétouan", "Tetouan", "El Jadida", "Safi", "Mohammedia", "Khouribga", "Benguerir", "Laâyoune", "Laayoune", "Dakhla",
)
# Signs of links, of misfiled documents and of noise.
APPLY_HINTS = ("موقع الإيداع", "التقديم", "الترشيح", "إيداع", "ايداع", "apply", "postuler", "candidature", "application form")
DOCUMENT_HINTS = ("تحميل", "قرار", "مقرر", "اللائحة", "النتائج", "communiqué", "communique", "download", "résultat", "resultat")


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def first_sign(text: Column, signs: tuple[tuple[str, str], ...], otherwise: str = "") -> Column:
    return ladders.first_of(*((text.rlike(pattern), label) for label, pattern in signs), otherwise=otherwise)


def has_any(text: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(text, F.lit(h))
    return out


def error_category(message: Column) -> Column:
    return first_sign(_lower(message), ERRORS, "provider_error")


def notice_type(title: Column, body: Column) -> Column:
    own = first_sign(_lower(title), NOTICES)
    return F.when(own != "", own).otherwise(first_sign(_lower(F.concat_ws(" ", title, body)), NOTICES, "vacancy"))


def notice_status(title: Column, body: Column) -> Column:
    return first_sign(_lower(F.concat_ws(" ", title, body)), NOTICE_STATUS)


def focus_priority(text: Column, entry_level: Column) -> Column:
    """4 for security, or technology for students; 3 for technology; 2 for students; else 0."""
    folded = _lower(text)
    cyber, student = folded.rlike(CYBER), F.coalesce(entry_level, F.lit(False)) | folded.rlike(STUDENT)
    tech = cyber | folded.rlike(TECH)
    return F.when(cyber | (tech & student), 4).when(tech, 3).when(student, 2).otherwise(0)


def employment_type(text: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    known = F.upper(F.translate(plain, "- ", "__"))
    return F.when(known.isin(*SCHEMA_TYPES), known).otherwise(ladders.first_of(*((has_any(plain, hints), value) for value, hints in EMPLOYMENT)))


def currency(text: Column, explicit: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(explicit, F.lit(""))))
    return F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(ladders.first_of(*((has_any(_lower(text), hints), value) for value, hints in CURRENCIES)))


def city(text: Column) -> Column:
    """The first city of the list that a text names, as a whole word."""
    padded = F.concat(F.lit(" "), F.regexp_replace(_lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return ladders.first_of(*((F.contains(padded, F.lit(f" {c.lower()} ")), c) for c in CITIES))


def link_kind(label: Column, href: Column) -> Column:
    """What a link is: ``document``, ``apply``, ``mail`` or ``other``."""
    text, address = _lower(label), _lower(href)
    return ladders.first_of(
        (F.startswith(address, F.lit("mailto:")), "mail"),
        (F.substring_index(address, "?", 1).rlike(r"\.(?:pdf|docx?)$"), "document"),
        (has_any(text, DOCUMENT_HINTS), "document"),
        (has_any(F.concat_ws(" ", text, address), APPLY_HINTS), "apply"),
        otherwise="other",
    )


def is_misfiled_document(label: Column, context: Column, url: Column) -> Column:
    """A document link that leads to an application: such words, none of a document's, and no PDF."""
    address = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    text = _lower(F.concat_ws(" ", label, context, url))
    return (address != "") & ~F.endswith(F.substring_index(address, "?", 1), F.lit(".pdf")) & has_any(text, APPLY_HINTS) & ~has_any(text, DOCUMENT_HINTS)


def name_similarity(a: Column, b: Column, stop: tuple[str, ...] = ()) -> Column:
    """1 where one name has the other in it, else shared words over the smaller name's."""
    norm = lambda c: F.trim(F.regexp_replace(_lower(c), r"[^\p{L}\p{N}_]+", " "))
    x, y = norm(a), norm(b)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: (F.char_length(w) > 1) & ~w.isin(*stop) if stop else F.char_length(w) > 1))
    least = F.least(F.size(words(x)), F.size(words(y)))
    shared = F.size(F.array_intersect(words(x), words(y)))
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).when(least == 0, 0.0).otherwise(shared / least)


def caption_fingerprint(caption: Column) -> Column:
    """Captions that differ in marks of direction, addresses, tags, case and punctuation alone have one fingerprint."""
    plain = F.regexp_replace(F.coalesce(caption, F.lit("")), r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")
    plain = F.regexp_replace(F.regexp_replace(texts.clean(F.lower(plain)), r"https?://\S+", ""), r"#[\p{L}\p{N}_]+", "")
    return F.substring(F.sha2(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", ""), 256), 1, 20)
