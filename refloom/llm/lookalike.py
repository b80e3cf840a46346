"""Text that looks the same in different characters, brought to one form.

The quick-check property of compatibility composition (NFKC_QC) and the combining class isolate the rows, and within a row
the segments, that normalisation could change; only those are normalised, with one stable character of context on either
side, and spliced into the unchanged text.  Stable characters begin no composition with what stands before them, so
nothing outside the segment and its context can change.

Two texts read the same if they agree in case folding and with each run of characters that are no letters, marks or digits
as one blank; what has no width vanishes, so a word that lost its blank stays another word.

Defined results: null gives null, '' and text without a letter or digit give ''; stable text costs no Python at all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn as Latin letters.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "Ѵ": "V", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "χ": "x", "γ": "y",
    # Armenian and Latin extensions
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ſ": "s", "Ɩ": "I",
}

_CHANGED = r"\p{NFKC_QC=No}\p{NFKC_QC=Maybe}\P{ccc=0}\p{Cf}\p{Default_Ignorable_Code_Point}" + "".join(LOOKALIKES)
#: Segments that normalisation may change; two with but one stable character between them are one, so that each has a
#: character of context of its own.
_UNSTABLE = regex.compile(rf"[^{_CHANGED}]?[{_CHANGED}]+(?:[^{_CHANGED}][{_CHANGED}]+)*[^{_CHANGED}]?", regex.DOTALL)
_IGNORABLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]+")
#: Everything set aside in comparison; marks stay, for they tell letters apart.
SET_ASIDE = r"[^\p{L}\p{N}\p{M}]+"
_ASIDE = regex.compile(SET_ASIDE)


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    return {ord(a): b for a, b in LOOKALIKES.items()}


@lru_cache(maxsize=1)
def _java_class() -> str:
    """The characters that may change, as ranges of a Java pattern, from the same properties."""
    one, ranges = regex.compile(f"[{_CHANGED}]"), []
    for i in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)):
        if one.match(chr(i)):
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def _segment(text: str) -> str:
    text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    return unicodedata.normalize("NFC", text.translate(_table()))


def canonical(text: str) -> str:
    """One form of the text: compatibility composition, look-alikes as Latin letters, nothing invisible."""
    return text if text.isascii() else _UNSTABLE.sub(lambda m: _segment(m[0]), text)


def reading(text: str) -> str:
    """The canonical form in lower case, runs of punctuation and blanks as one blank: equal where two texts read the same."""
    return _ASIDE.sub(" ", canonical(text).lower().replace("ß", "ss").replace("ς", "σ")).strip(" ")


def is_stable(c: Column) -> Column:
    """The quick check, in the JVM: no character that normalisation may change."""
    return c.rlike(rf"^(?:[\x00-\x7F]++|[^\x00-\x7F{_java_class()}])*+$")


@F.pandas_udf(T.StringType())
def _canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def _reading(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(reading, na_action="ignore")


def _routed(df: DataFrame, column: str, out: str, stable: Column, udf) -> DataFrame:
    c = F.col(f"`{column}`")
    rest = [F.col(f"`{x}`") for x in df.columns if x != out]
    calm = is_stable(F.coalesce(c, F.lit("")))
    return df.filter(calm).select(*rest, stable.alias(out)).unionByName(df.filter(~calm).select(*rest, udf(c).alias(out)))


def with_canonical(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """Adds the canonical form of ``column``; replaces a column named ``out``."""
    return _routed(df, column, out, F.col(f"`{column}`"), _canonical)


def with_reading(df: DataFrame, column: str, out: str = "reading") -> DataFrame:
    """Adds the form that is equal for texts that read the same; replaces a column named ``out``."""
    folded = F.replace(F.replace(F.lower(F.col(f"`{column}`")), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return _routed(df, column, out, F.trim(F.regexp_replace(folded, SET_ASIDE, " ")), _reading)


def reads_like(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows of both sides that read the same, joined; texts with nothing to read match nothing.

    A title that very many rows share is split by the engine's skew join, on either side.
    """
    a = with_reading(left, left_on, "__reading").filter(F.col("__reading") != "")
    b = with_reading(right, right_on, "__reading").filter(F.col("__reading") != "")
    return a.join(b, "__reading").drop("__reading")
