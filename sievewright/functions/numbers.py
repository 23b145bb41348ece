"""Numbers and embedded structures in page text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Arabic-Indic digits.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, "0123456789")


def amounts(text: Column) -> Column:
    """The first two numbers of a salary text, thousands separators of either kind taken out."""
    found = F.regexp_extract_all(ascii_digits(text), F.lit(r"[0-9]{1,3}(?:[ .,][0-9]{3})+(?![0-9])|[0-9]+(?:[.,][0-9]{1,2})?"), F.lit(0))
    whole = lambda n: F.when(n.rlike(r"^[0-9]{1,3}([ .,][0-9]{3})+$"), F.regexp_replace(n, "[ .,]", "")).otherwise(F.regexp_replace(n, ",", "."))
    return F.slice(F.transform(found, lambda n: whole(n).try_cast("double")), 1, 2)


def salary_range(text: Column) -> Column:
    """``(low, high)`` of a salary text."""
    got = amounts(text)
    return F.struct(F.array_min(got).alias("low"), F.array_max(got).alias("high"))


def positions(text: Column) -> Column:
    """The number of posts that a text names, 0 for none."""
    plain = F.lower(ascii_digits(text))
    tries = [r"([0-9]{1,5})\s*(?:postes?|positions?|posts|seats|منصب|مناصب)", r"(?:postes?|positions?|number of posts|عدد المناصب)\s*[:=]\s*([0-9]{1,5})"]
    return F.coalesce(*(F.nullif(F.regexp_extract(plain, p, 1), F.lit("")).try_cast("int") for p in tries), F.lit(0))


def currency(text: Column) -> Column:
    upper = F.upper(text)
    return F.when(upper.rlike("MAD|DH|درهم"), "MAD").when(upper.rlike("EUR|€"), "EUR").when(upper.rlike(r"USD|\$"), "USD").otherwise("")


def next_page(url: Column) -> Column:
    """The address of the following page: the query's page number and one, or page 2."""
    n = F.regexp_extract(url, r"[?&]page=([0-9]+)", 1)
    plain = F.regexp_replace(url, "#.*$", "")
    more = F.concat(plain, F.when(F.contains(plain, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("page=2"))
    return F.when(n == "", more).otherwise(F.regexp_replace(plain, F.lit(r"([?&]page=)[0-9]+"), F.concat(F.lit("$1"), (n.try_cast("int") + 1).cast("string"))))


def feed_links(html: Column) -> Column:
    """Addresses of the feeds that a page declares."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*application/(?:rss|atom)\+xml[^>]*>"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href=["']?([^"'\s>]+)""", 1)), lambda h: h != ""))


def object_after(text: str | None, marker: str) -> str | None:
    """The first whole JSON object after a marker."""
    at = (text or "").find(marker)
    start = (text or "").find("{", at + len(marker)) if at >= 0 else -1
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None
    return json.dumps(found, ensure_ascii=False, sort_keys=True)


def json_after(text: Column, marker: str) -> Column:
    """``object_after`` of a column; braces nest, which no regular expression follows."""

    @F.pandas_udf(StringType())
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: object_after(t, marker))

    return find(text)
