"""Normal-form keys as Spark expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Ligatures and what they stand for, for F5.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _decomposed() -> tuple[str, str]:
    """Characters that compatibility decomposition takes apart into one ASCII character and marks, and that character."""
    pairs = []
    for i in (*range(0xA0, 0x250), *range(0x1E00, 0x2200), *range(0xFF01, 0xFF5F)):
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs.append((chr(i), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _decomposed()
#: Letters with strokes, which no decomposition takes apart, and the letters they are keyed under.
STROKED, UNSTROKED = "øØłŁđĐħĦıŧŦ", "oOlLdDhHitT"


def deaccent(c: Column) -> Column:
    """Accented letters as plain ones; others stay."""
    return F.translate(c, ACCENTED + STROKED, PLAIN + UNSTROKED)


def journal_key(c: Column) -> Column:
    """K5: lower case, "&" as " and ", other punctuation as blanks, blanks squeezed, a leading "the " dropped."""
    c = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"^the ", "")


def arxiv_key(c: Column) -> Column:
    """K4: lower case, every run of characters other than a-z and digits one blank; accents are not removed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def ascii_key(c: Column) -> Column:
    """K2/K3: decomposed, letters that are no ASCII then left out, lower case, every run of other characters one blank.

    Dashes and quotation marks beyond ASCII are such characters, so that words on either side stay apart.
    """
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    plain = F.regexp_replace(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[\p{P}\p{Z}\p{S}]+", " "), r"[^\x00-\x7F]+", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))


def title_key(parts: pd.Series) -> pd.Series:
    """K1 of texts: entities unescaped, markup out, decomposed without marks, case folded, every run of other characters one
    blank; letters of any script stay.  Null stays null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        for _ in range(3):
            t = html.unescape(t)
        t = unicodedata.normalize("NFKD", re.sub(r"<[^>]*>", " ", t))
        return re.sub(r"[\W_]+", " ", "".join(ch for ch in t if not unicodedata.combining(ch)).casefold()).strip()

    return parts.map(one)


#: K1 as a column function.
unicode_key = F.pandas_udf(title_key, T.StringType())


def doi_key(c: Column) -> Column:
    """K6: without resolver and scheme, without closing punctuation, lower case; null if nothing is left."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    c = F.regexp_replace(c, r"[.,;)]+$", "")
    return F.when(c != "", c)


def page_key(c: Column) -> Column:
    """K7: lower case, a leading "e" before digits and leading zeros dropped ("0" stays)."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^e([0-9]+)$", "$1")
    return F.regexp_replace(c, r"^0+(.)", "$1")


def volume_key(c: Column) -> Column:
    """K8: the leading letters and digits, lower case."""
    return F.lower(F.regexp_extract(F.trim(c), r"^([0-9A-Za-z]+)", 1))


def surname(c: Column) -> Column:
    """K9: the longest word of three letters or more, folded; the first of several as long; null if there is none."""
    words = F.filter(F.split(F.lower(deaccent(c)), r"[^a-z]+"), lambda w: F.length(w) >= 3)
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    return F.get(F.filter(words, lambda w: F.length(w) == longest), F.lit(0))


def acronym(c: Column) -> Column:
    """Initials of the words of a journal's name that count; null for fewer than two."""
    words = F.filter(F.split(journal_key(c), " "), lambda w: (w != "") & ~w.isin(*ACRONYM_STOP))
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


#: Words that no acronym takes a letter from, and words without content in a title.
ACRONYM_STOP = ("of", "the", "and", "in", "on", "for", "a", "an", "de", "la", "le", "des", "du", "der", "die", "und")
TITLE_STOP = ("the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "with")


def content_tokens(c: Column) -> Column:
    """Words of three letters or more that are no stop words; words cut by a hyphen are joined first."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(\w)-\s*(\w)", "$1$2")
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters among letters and digits; empty for shorter texts."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3)))
    return F.when(F.length(c) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
