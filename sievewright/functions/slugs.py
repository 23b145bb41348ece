"""Readable stems of addresses: Latin letters of any script that the table knows, and English words of Arabic and French titles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bound

# Latin spelling of Arabic letters.
ARABIC = {
    "ا": "a", "أ": "a", "إ": "a", "آ": "a", "ء": "a", "ؤ": "w", "ئ": "y", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s",
    "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "a", "و": "w", "ي": "y", "ى": "a",
}
# English names of places and phrases, in order; English words of Latin ones; words that no stem has.
PLACES = {
    "الدار البيضاء": "casablanca", "الرباط": "rabat", "مراكش": "marrakech", "فاس": "fes", "طنجة": "tangier", "وجدة": "oujda", "أكادير": "agadir", "اكادير": "agadir", "القنيطرة": "kenitra",
    "الجديدة": "el jadida", "تطوان": "tetouan", "مكناس": "meknes", "سلا": "sale",
}
PHRASES = {
    "أستاذ محاضر": "lecturer", "أستاذ التعليم العالي": "professor", "أستاذ": "professor", "مهندس دولة": "engineer", "مهندس": "engineer", "تقني متخصص": "specialist technician", "تقني": "technician",
    "متصرف": "administrator", "مستشار": "consultant", "مدير": "manager", "محاسب": "accountant", "مطور": "developer", "الأمن السيبراني": "cybersecurity", "أمن سيبراني": "cybersecurity",
    "المعلوميات": "it", "الإعلاميات": "it", "شبكات": "network", "الموارد البشرية": "human resources", "موارد بشرية": "human resources", "التسويق": "marketing", "المبيعات": "sales", "جامعة": "university",
    "وزارة": "ministry", "وكالة": "agency", "المكتب": "office", "مكتب": "office", "المعهد": "institute", "معهد": "institute", "كلية": "faculty",
}
LATIN = {
    "tawzif": "recruitment", "twzyf": "recruitment", "wadifa": "job", "wadif": "job", "wadaif": "jobs", "moubarat": "competition", "mobarate": "competition", "moubara": "competition", "ingenieur": "engineer",
    "ingenieurs": "engineer", "technicien": "technician", "techniciens": "technician", "responsable": "manager", "developpeur": "developer", "developpeurs": "developer", "comptable": "accountant",
    "consultante": "consultant", "stagiaire": "intern", "stage": "internship", "securite": "security", "informatique": "it", "reseaux": "network", "reseau": "network", "emploi": "job", "recrutement": "recruitment",
}
STOP = ("a", "an", "and", "at", "de", "des", "du", "en", "et", "for", "la", "le", "les", "of", "the", "to", "with", "job", "jobs", "recruitment")


def _folded() -> dict[str, str]:
    """Characters of compatibility forms and letters with marks, by the rule of Unicode: the ASCII or Arabic letters that are left without marks."""
    out = {}
    for first, last in ((0xA0, 0x24F), (0x622, 0x626), (0x1E00, 0x1EFF), (0x2000, 0x2BFF), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0xFF01, 0xFF5E)):
        for c in map(chr, range(first, last + 1)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain != c:
                out[c] = plain
    return out


FOLDED = _folded()


def transliterated(text: Column, table: Mapping[str, str]) -> Column:
    """The text with each of the table's strings replaced, the longest that stands at a place, from left to right."""
    keys = sorted(table, key=len, reverse=True)
    spelling = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    single = "".join(re.escape(k) for k in keys if len(k) == 1)
    long = [re.escape(k) for k in keys if len(k) > 1]
    pattern = "(?s)" + "|".join([*long, *([f"[{single}]"] if single else []), f"[^{single}]" if single else "."])
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.coalesce(F.try_element_at(spelling, c), c)), "")


def _ascii(text: Column) -> Column:
    """ASCII letters and characters of the text without marks; others are left out."""
    plain = F.regexp_replace(text, r"\p{Mn}+", "")
    one = {c: p for c, p in FOLDED.items() if len(p) == 1}
    more = {c: p for c, p in FOLDED.items() if len(p) > 1 and p.isascii()}
    plain = F.translate(plain, "".join(one), "".join(one.values()))
    return bound(plain, lambda t: F.when(t.rlike(f"[{''.join(map(re.escape, more))}]"), transliterated(t, more)).otherwise(t))


def latinized(text: Column) -> Column:
    """Lower-case ASCII letters in words joined by hyphens; Arabic letters as the table spells them."""
    spelt = bound(_ascii(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike("[؀-ۿ]"), transliterated(t, ARABIC)).otherwise(t))
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(spelt, r"[^\x00-\x7F]", "")), "[^a-z]+", "-"), F.lit("-"))


def stem(company: Column, title: Column, words: int = 8, length: int = 90) -> Column:
    """The first words of company and title: no digits, so that dates, places and references never change it."""
    all_words = F.filter(F.split(F.concat_ws("-", latinized(company), latinized(title)), "-"), lambda w: w != "")
    joined = bound(F.array_join(F.slice(all_words, 1, words), "-"), lambda t: F.when(t == "", F.lit("job")).otherwise(t))
    return F.btrim(F.substring(joined, 1, length), F.lit("-"))


def english_words(text: Column) -> Column:
    """Words of a text in English where places, phrases and words are known; without stop words and single letters."""
    lower = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    for table in (PLACES, PHRASES):
        for source, target in table.items():
            lower = F.replace(lower, F.lit(source), F.lit(f" {target} "))
    plain = F.lower(F.regexp_replace(_ascii(lower), r"[^\x00-\x7F]", ""))
    known = F.create_map(*(F.lit(x) for kv in LATIN.items() for x in kv))
    mapped = F.transform(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(known, w), w))
    return F.filter(mapped, lambda w: (F.char_length(w) > 1) & ~w.isin(*STOP))


def english_stem(company: Column, title: Column, location: Column) -> Column:
    """Two words of the company, three of the title, two of the location, each once."""
    first = lambda c, n: F.slice(english_words(c), 1, n)
    filled = lambda w: F.when(F.size(w) == 0, F.array(F.lit("employment"), F.lit("opportunity"))).when(F.size(w) == 1, F.concat(w, F.array(F.lit("job")))).otherwise(w)
    words = bound(F.array_distinct(F.concat(first(company, 2), first(title, 3), first(location, 2))), filled)
    return F.btrim(F.substring(F.array_join(F.slice(words, 1, 7), "-"), 1, 80), F.lit("-"))
