"""Text normalisers, fingerprints, extractors and predicates as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .urls import bound

# Words that say nothing of a topic.
STOPWORDS = (
    "the", "a", "an", "and", "or", "to", "of", "for", "in", "on", "with", "by", "from", "as", "is", "are",
    "new", "news", "report", "says", "how", "why", "what", "this", "that", "after", "over", "into", "about", "best", "top",
)
# Names whose values are redacted.
SECRET_NAMES = "api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|authorization|bot[_-]?token"
MARK = "[redacted]"
#: Letters, digits and underscore of any script (``\w`` is ASCII in Spark).
WORDS = r"[\p{L}\p{N}_]+"


def clean(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    """The empty text is the null of the data model."""
    return F.nullif(F.trim(text), F.lit(""))


def stable_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, length)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def title_hash(title: Column) -> Column:
    """Hash of the lower-cased title without punctuation."""
    return stable_hash(F.regexp_replace(clean(F.lower(title)), r"[^\p{L}\p{N}_ ]+", ""))


def topic_keywords(title: Column, limit: int = 8) -> Column:
    """The first distinct keywords: CVE numbers, then words of three or more letters that are no stop words."""
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_ .-]+", " ")
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[a-z0-9][a-z0-9.-]{2,}"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", ""))
    words = F.filter(found, lambda w: (F.char_length(w) >= 3) & ~w.isin(*STOPWORDS))
    numbers = F.regexp_extract_all(text, F.lit(r"cve-\d{4}-\d{4,7}"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(numbers, words)), 1, limit)


def topic_signature(title: Column) -> Column:
    """Hash of the sorted CVE numbers, else of the sorted keywords, else of the title."""
    keywords = topic_keywords(title)
    numbers = F.filter(keywords, lambda w: F.startswith(w, F.lit("cve-")))
    joined = lambda a: stable_hash(F.array_join(F.array_sort(a), " "), 20)
    return F.when(F.size(numbers) > 0, joined(numbers)).when(F.size(keywords) == 0, title_hash(title)).otherwise(joined(keywords))


def content_hash(text: Column) -> Column:
    return stable_hash(clean(F.lower(text)), 24)


def failure_fingerprint(stage: Column, reason: Column) -> Column:
    """Failures that differ in addresses, hex ids and numbers alone have one fingerprint."""
    masked = F.lower(clean(reason))
    for pattern, mark in ((r"https?://\S+", "<url>"), (r"\b[0-9a-f]{8,}\b", "<hex>"), (r"\d+", "<n>")):
        masked = F.regexp_replace(masked, pattern, mark)
    return F.substring(F.sha2(F.concat_ws("|", F.lower(stage), masked), 256), 1, 20)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("int")


def redact(text: Column) -> Column:
    """Bearer tokens and the values of secret names replaced."""
    out = F.regexp_replace(clean(text), r"Bearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {MARK}")
    out = F.regexp_replace(out, r"access_token=[^&\s]+", f"access_token={MARK}")
    return F.regexp_replace(out, rf"(?i)({SECRET_NAMES})(['\"]?\s*[:=]\s*['\"]?)[^,'\"\s}}]+", rf"$1$2{MARK}")


def redact_map(fields: Column) -> Column:
    """A map's values, redacted where the key is a secret name."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(f"(?i){SECRET_NAMES}"), F.lit(MARK)).otherwise(v))


def block_fingerprints(text: Column, least: int = 80, size: int = 180) -> Column:
    """Fingerprints of the sentences of ``least`` or more characters: their letters and digits, at most ``size``."""
    chunks = F.split(F.regexp_replace(clean(text), r"[.!?]\s+", "\n"), "\n")
    long = F.filter(F.transform(chunks, lambda c: F.trim(c)), lambda c: F.char_length(c) >= least)
    return F.transform(long, lambda c: F.substring(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", ""), 1, size))


def has_repeated_blocks(text: Column) -> Column:
    return has_twice(block_fingerprints(text))


def has_twice(values: Column) -> Column:
    """Whether an array has a value twice."""
    return bound(values, lambda v: F.size(v) > F.size(F.array_distinct(v)))


def script_share(text: Column, script: str) -> Column:
    """Share of the letters that are of a Unicode script, 0 to 1."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(text, F.lit(rf"\p{{Is{script}}}")) / letters)


def looks_like_markup(text: Column) -> Column:
    """Visible JSON or Markdown."""
    return text.rlike(r'(?m)^\s*[{\[]\s*"|"\s*:\s*["{\[]|^\s*#{1,6}\s|\*\*[^*\n]+\*\*|```')


def slug(text: Column, words: int = 8, length: int = 90) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    found = F.slice(F.regexp_extract_all(plain, F.lit("[a-z][a-z0-9]*"), F.lit(0)), 1, words)
    return F.regexp_replace(F.substring(F.array_join(found, "-"), 1, length), "-+$", "")


def trim_to_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, back to the last sentence end in the second half."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.char_length(text) <= most, text).when(F.char_length(whole) * 2 >= most, whole).otherwise(F.rtrim(head))


def dates(text: Column) -> Column:
    """Distinct valid dates ``yyyy-MM-dd`` of the forms d/m/y and y/m/d, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})(?![0-9])"), F.lit(0))
    pieces = F.transform(found, lambda d: F.split(d, "[-/]"))
    iso = F.transform(
        pieces,
        lambda p: F.when(F.char_length(p[0]) == 4, F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0"))).otherwise(
            F.concat_ws("-", p[2], F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0"))
        ),
    )
    valid = F.transform(iso, lambda d: F.date_format(F.try_to_date(d, "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.array_distinct(F.array_compact(valid))


@F.pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, without Arabic marks, punctuation as spaces; SQL has no NFKC."""
    folded = texts.fillna("").map(lambda t: unicodedata.normalize("NFKC", t).casefold())
    marks = folded.str.replace("[ً-ٰٟ]", "", regex=True)
    return marks.str.replace(r"[^\w؀-ۿ]+", " ", regex=True).str.strip()


# Month names in English, French and Arabic, folded as ``folded`` does.
MONTHS = {
    1: "january jan janvier يناير", 2: "february feb fevrier فبراير", 3: "march mar mars مارس", 4: "april apr avril ابريل",
    5: "may mai ماي مايو", 6: "june jun juin يونيو", 7: "july jul juillet يوليوز يوليو", 8: "august aug aout غشت اغسطس",
    9: "september sept sep septembre شتنبر سبتمبر", 10: "october oct octobre اكتوبر", 11: "november nov novembre نونبر نوفمبر", 12: "december dec decembre دجنبر ديسمبر",
}
# Labels of a deadline, folded.
DEADLINE_LABELS = "اخر اجل|الى غاية|قبل|date limite|dernier delai|deadline|last date|cloture|jusqu(?:'|’)?au|avant le"


def folded(text: Column) -> Column:
    """Lower case, one space at a time, Arabic marks dropped and letter forms united, French accents dropped."""
    plain = F.translate(F.lower(clean(text)), "أإآى", "اااي")
    plain = F.translate(plain, "àâçéèêëîïôùûü", "aaceeeeiiouuu")
    return F.regexp_replace(plain, "[ً-ٰٟـ]", "")


def _month(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for n, names in MONTHS.items() for name_ in names.split() for x in (name_, f"{n:02d}")))
    return table[name]


_NAMES = "|".join(sorted((n for names in MONTHS.values() for n in names.split()), key=len, reverse=True))


def written_dates(text: Column) -> Column:
    """Distinct valid dates ``yyyy-MM-dd`` written with a month's name, in order."""
    found = F.regexp_extract_all(folded(text), F.lit(rf"(?<![0-9])[0-9]{{1,2}} (?:{_NAMES}) [0-9]{{4}}(?![0-9])"), F.lit(0))
    iso = F.transform(found, lambda d: F.concat_ws("-", F.split(d, " ")[2], _month(F.split(d, " ")[1]), F.lpad(F.split(d, " ")[0], 2, "0")))
    valid = F.transform(iso, lambda d: F.date_format(F.try_to_date(d, "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.array_distinct(F.array_compact(valid))


def deadline(text: Column, labels: str = DEADLINE_LABELS) -> Column:
    """The first date after a label, at most 45 characters on; null for none."""
    after = F.regexp_extract(folded(text), rf"(?:{labels})[^0-9]{{0,45}}([0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}|[0-9]{{1,2}} (?:{_NAMES}) [0-9]{{4}})", 1)
    return F.try_element_at(F.concat(dates(after), written_dates(after)), F.lit(1))


def first_date(text: Column) -> Column:
    """The date, numeric or written, that a text has first; null for none."""
    folded_ = folded(text)
    form = rf"(?<![0-9])(?:[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}}|[0-9]{{1,2}} (?:{_NAMES}) [0-9]{{4}})(?![0-9])"
    each = F.transform(F.regexp_extract_all(folded_, F.lit(form), F.lit(0)), lambda d: F.try_element_at(F.concat(dates(d), written_dates(d)), F.lit(1)))
    return F.try_element_at(F.array_compact(each), F.lit(1))
